"""Typing, cleaning, de-duplication and resampling of readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorcast.config import MEASURES, STATION, TIME
from sensorcast.functions import casts
from sensorcast.operators.quantiles import grouped_quantiles, quantiles
from sensorcast.schema import RAW_READING_SCHEMA, READING_SCHEMA, REJECT

_BROKEN = "_broken"
# Separator-only columns at the end of the sensor files.
BLANK_COLUMNS = ("", "_c15", "_c16", "_c17", "_c18", "_c19")


def type_readings(raw: DataFrame, source_zone: str | None = None) -> DataFrame:
    """Text columns to the reading schema; values that cannot be read become null."""
    typed = {}
    for column in READING_SCHEMA:
        if column.name in raw.columns:
            kind = column.dataType.typeName()
            if kind == "double":
                typed[column.name] = casts.to_number(F.col(column.name))
            elif kind == "timestamp":
                typed[column.name] = casts.to_instant(F.col(column.name), source_zone)
    return raw.withColumns(typed)


def decode_messages(messages: DataFrame, source_zone: str | None = None) -> DataFrame:
    """JSON in ``value`` to typed readings, plus the original text and the reason to reject it.

    All fields are first read as text, so a field of the wrong type costs that field only.
    """
    text = F.col("value").cast("string")
    schema = T.StructType([*RAW_READING_SCHEMA.fields, T.StructField(_BROKEN, T.StringType())])
    record = F.from_json("_text", schema, {"columnNameOfCorruptRecord": _BROKEN})
    others = [c for c in messages.columns if c != "value" and c not in READING_SCHEMA.names]
    # A generator rather than a projection: filters on the fields stay above it, so that the text is
    # parsed once and not again in every filter.
    raw = messages.withColumn("_text", text).select("_text", *others, F.inline(F.array(record)))
    typed = type_readings(raw.withColumn("_time_text", F.col(TIME)), source_zone)
    reason = (
        F.when((F.coalesce(F.trim("_text"), F.lit("")) == "") | F.col(_BROKEN).isNotNull(), F.lit("not json"))
        .when(F.col(STATION).isNull(), F.lit("no station"))
        .when(F.col("_time_text").isNull(), F.lit("no time"))
        .when(F.col(TIME).isNull(), F.lit("unreadable time"))
    )
    return typed.withColumn(REJECT, reason).drop("_time_text", _BROKEN).withColumnRenamed("_text", "value")


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(REJECT).isNull()).drop(REJECT, "value")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(REJECT).isNotNull()).select("value", REJECT)


def clean_sensor_rows(raw: DataFrame, measures: Sequence[str], sentinel: float = -200.0) -> DataFrame:
    """Rows of a sensor file: one timestamp, decimal commas read, sentinel values nulled."""
    cleaned = raw.drop(*BLANK_COLUMNS).withColumn(TIME, casts.date_and_time(F.col("Date"), F.col("Time")))
    return cleaned.withColumns(
        {m: casts.drop_sentinel(casts.decimal_comma(F.col(m)), sentinel) for m in measures}
    )


def null_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = -200.0) -> DataFrame:
    return df.withColumns({c: casts.drop_sentinel(F.col(c), sentinel) for c in columns})


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null or NaN in ``columns``."""
    return df.dropna(subset=list(columns))


def keep_last(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (STATION, TIME)) -> DataFrame:
    """One row per key, the last by ``order``. The survivor is picked on the map side first, so a
    key with very many copies sends one row per task."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def resample_hourly(df: DataFrame, measures: Sequence[str] = MEASURES, also: Sequence[str] = ()) -> DataFrame:
    """Mean of each measure per station and hour. ``also`` are station attributes kept in the key."""
    hour = F.date_trunc("hour", TIME).alias(TIME)
    return df.groupBy(STATION, *also, hour).agg(
        *[F.avg(m).alias(m) for m in measures], F.count(F.lit(1)).alias("readings")
    )


Bounds = Mapping[str, tuple[float | None, float | None]]


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """True where the value is NaN or beyond a bound; null values are not outside."""
    test = F.isnan(value)
    if low is not None:
        test = test | (value < F.lit(low))
    if high is not None:
        test = test | (value > F.lit(high))
    return F.coalesce(value.isNotNull() & test, F.lit(False))


def null_out_of_range(df: DataFrame, bounds: Bounds) -> DataFrame:
    return df.withColumns(
        {c: F.when(~outside(F.col(c), *limits), F.col(c)) for c, limits in bounds.items()}
    )


def flag_out_of_range(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Add ``out_of_range``: the names of the columns beyond their bounds, comma-separated in the
    order given, empty when all are fine."""
    names = [F.when(outside(F.col(c), *limits), F.lit(c)) for c, limits in bounds.items()]
    return df.withColumn("out_of_range", F.concat_ws(",", *names))


def quantile_bounds(df: DataFrame, measures: Sequence[str], low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """Outlier bounds per measure: its values at two quantiles, of the whole table or of each group of ``keys``."""
    found = grouped_quantiles(df, keys, measures, [low, high]) if keys else quantiles(df, measures, [low, high])
    at = lambda p: F.max(F.when(F.col("probability") == p, F.col("value")))
    return found.groupBy(*keys, "measure").agg(at(low).alias("low"), at(high).alias("high"))


def flag_outliers(df: DataFrame, bounds: DataFrame, measures: Sequence[str], keys: Sequence[str] = (STATION,)) -> DataFrame:
    """Add ``outliers``: the names of the measures beyond the bounds of the row's own group, comma-separated in the
    order given. NaN is an outlier; a group or measure without bounds has no other."""
    names = [f"_key{i}" for i in range(len(keys))]
    limits = F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high"))))  # one entry per measure
    per_group = bounds.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).agg(limits.alias("_limits"))
    match = F.lit(True)
    for k, n in zip(keys, names):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(n))
    flags = []
    for m in measures:
        own = F.col("_limits")[m]
        beyond = F.coalesce((F.col(m) < own["low"]) | (F.col(m) > own["high"]), F.lit(False))
        flags.append(F.when(F.isnan(m) | beyond, F.lit(m)))
    joined = df.join(per_group, match, "left").withColumn("outliers", F.concat_ws(",", *flags))
    return joined.drop("_limits", *names)
