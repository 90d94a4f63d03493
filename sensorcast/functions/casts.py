"""Tolerant conversions of outside text. A value that cannot be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def decimal_comma(value: Column) -> Column:
    """``"2,6"`` -> 2.6"""
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def drop_sentinel(value: Column, sentinel: float) -> Column:
    """Null where the value is the marker for "not measured"."""
    return F.nullif(value, F.lit(float(sentinel)))


def to_instant(value: Column, source_zone: str | None = None) -> Column:
    """ISO text to timestamp. Text without an offset is read in ``source_zone`` when one is given,
    otherwise in the session zone."""
    if source_zone is None:
        return F.try_to_timestamp(value)
    # Text that carries its own offset keeps it; only bare local times are shifted.
    has_offset = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.convert_timezone(F.lit(source_zone), F.lit("UTC"), value.try_cast("timestamp_ntz"))
    as_utc = F.try_make_timestamp(
        F.year(local), F.month(local), F.dayofmonth(local), F.hour(local), F.minute(local),
        F.extract(F.lit("SECOND"), local), F.lit("UTC"),
    )
    return F.when(has_offset, F.try_to_timestamp(value)).otherwise(as_utc)


def date_and_time(date: Column, time: Column, fmt: str = "dd/MM/yyyy HH.mm.ss") -> Column:
    """Timestamp from a date column and a time column."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt))
