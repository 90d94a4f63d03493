"""Calendar features and time shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorcast.config import DISPLAY_FORMAT, DISPLAY_ZONE


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("double")


def day_of_week_fraction(ts: Column) -> Column:
    """Days since Sunday 00:00 UTC including the part of the day: Monday 01:00 is 1.0417."""
    return F.pmod(F.unix_seconds(ts) / F.lit(86400.0) + F.lit(4.0), F.lit(7.0))


def day_of_week(ts: Column) -> Column:
    """Whole day of the week, Sunday is 0."""
    return F.dayofweek(ts) - F.lit(1)


def hours_later(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0))


def display_time(ts: Column, zone: str = DISPLAY_ZONE, fmt: str = DISPLAY_FORMAT) -> Column:
    """Text of a UTC timestamp in the zone shown to readers. Needs session time zone UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), fmt)
