"""Batch sources. Schemas are fixed, so no source needs an inference pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.config import TIME
from sensorcast.functions.casts import to_instant
from sensorcast.operators.clean import clean_sensor_rows, type_readings
from sensorcast.schema import (
    GEOJSON_SCHEMA,
    LANDED_AT,
    LANDED_OR_REJECTED,
    LANDED_SCHEMA,
    PAYLOAD_FIELDS,
    PAYLOAD_SCHEMA,
    RAW_READING_SCHEMA,
    READING_SCHEMA,
    REJECT,
    REJECTED_TEXT,
    SOURCE_POSITION,
    STORED_FORECAST_SCHEMA,
)


def read_readings_csv(spark: SparkSession, path: str, source_zone: str | None = None) -> DataFrame:
    """Comma-separated readings. The header line of each file must name the columns of the schema,
    in that order; a file with others is an error, not a shift of its values."""
    raw = spark.read.schema(RAW_READING_SCHEMA).csv(path, header=True, enforceSchema=False)
    return type_readings(raw, source_zone)


def read_readings_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READING_SCHEMA).parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Readings landed by ``ingest_readings``. Spark honours the commit log of the stream sink, so
    files of an unfinished batch are not seen. The reason is a folder, so rejects are not read."""
    return accepted_rows(spark.read.schema(LANDED_OR_REJECTED).parquet(path))


def accepted_rows(landed: DataFrame) -> DataFrame:
    """The readings among all that ``ingest_readings`` landed, batch or stream."""
    return landed.filter(F.col(REJECT).isNull()).select(LANDED_SCHEMA.names)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecasts stored by ``score_stream``, all versions of them; ``last_forecasts`` picks the last."""
    return spark.read.schema(STORED_FORECAST_SCHEMA).parquet(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Messages that ``ingest_readings`` could not take: text, reason, time of landing and position."""
    bad = spark.read.schema(LANDED_OR_REJECTED).parquet(path).filter(F.col(REJECT).isNotNull())
    return bad.select(F.col(REJECTED_TEXT).alias("value"), REJECT, LANDED_AT, *[f.name for f in SOURCE_POSITION])


def read_sensor_csv(spark: SparkSession, path: str, measures: Sequence[str]) -> DataFrame:
    """Semicolon-separated file of one sensor station: Date, Time, the measures, blank columns.

    Columns are found by their names in the header, in any order and case and whatever stands in brackets
    behind them, as in CO(GT); a missing one is an error. Rows in which all of them are empty are
    dropped; a row that only lacks its date keeps its measures, without a timestamp."""
    names = ["Date", "Time", *measures]
    found = spark.read.csv(path, header=True, sep=";", enforceSchema=False)
    named = {c.partition("(")[0].strip().lower(): c for c in reversed(found.columns)} | {c: c for c in found.columns}
    at = {n: named.get(n, named.get(n.lower())) for n in names}
    missing = [n for n, column in at.items() if column is None]
    if missing:
        raise ValueError(f"the header of {path} lacks {', '.join(missing)}")
    raw = found.select(*[F.col(f"`{column}`").alias(n) for n, column in at.items()])
    return clean_sensor_rows(raw.filter(F.coalesce(*[F.nullif(F.trim(f"`{n}`"), F.lit("")) for n in names]).isNotNull()), measures)


def flatten_payload(df: DataFrame, payload: Column, keep: Sequence[str], source_zone: str | None = None) -> DataFrame:
    """JSON answers of the weather service, whose measures are parallel arrays, to one row per hour.
    A measure without an array is null in every row; an unreadable answer has no rows."""
    hourly = F.from_json(payload, PAYLOAD_SCHEMA)["hourly"]
    # Zipping with a null array would lose all rows, with an empty one it fills up with nulls.
    none = F.array().cast("array<double>")
    arrays = [hourly["time"].alias("time"), *[F.coalesce(hourly[f], none).alias(f) for f in PAYLOAD_FIELDS]]
    rows = df.select(*keep, *arrays).select(*keep, F.inline(F.arrays_zip("time", *PAYLOAD_FIELDS)))
    return rows.select(
        *keep,
        to_instant(F.col("time"), source_zone).alias(TIME),
        *[F.col(field).alias(measure) for field, measure in PAYLOAD_FIELDS.items()],
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region codes of a GeoJSON file. Only the codes are parsed, not the shapes."""
    features = spark.read.schema(GEOJSON_SCHEMA).json(path, multiLine=True)
    return features.select(F.explode("features.properties.shapeISO").alias("region_iso"))
