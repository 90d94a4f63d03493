"""The readings table behind every query, derived from ``events``.

Each event type plays a station: its value is the PM2.5 reading and the other columns supply the
remaining measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.config import MEASURES, Chunking, FeatureConfig
from sensorcast.functions.stations import station_dimension

CODES = (("click", 0.0), ("error", 1.0), ("purchase", 2.0))
CONFIG = FeatureConfig(station_codes=CODES, unknown_code=3.0)
# Small enough that every station is cut into chunks at the scale of the check.
SMALL_CHUNKS = Chunking(rows_per_chunk=300)
LATITUDE = {"click": 10.0, "error": 16.0, "purchase": 21.0}
BOUNDS = {"pm25": (1.0, 250.0), "pm10": (None, 300.0), "co": (5.0, None)}
DIMENSION = (
    ("click", "Click", 10.0, 100.0, 0.0, "VIETNAM"),
    ("error", "Error", 16.0, 100.0, 1.0, "CHINA"),
    ("purchase", "Purchase", 21.0, 100.0, 2.0, "JAPAN"),
    ("signup", "Signup", 0.0, 100.0, 3.0, "INDIA"),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str, station: str = "event_type", extra: tuple[str, ...] = ()) -> DataFrame:
    station_id = F.col(station).cast("string")
    k = F.get_json_object("props", "$.k").cast("double")
    latitude = F.coalesce(*[F.when(station_id == n, F.lit(v)) for n, v in LATITUDE.items()], F.lit(0.0))
    return events(spark, sf_dir).select(
        station_id.alias("location_id"),
        F.initcap(station_id).alias("location_name"),
        latitude.alias("latitude"),
        F.lit(100.0).alias("longitude"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("pm25"),
        (F.col("value") + k).alias("pm10"),
        k.alias("co"),
        (F.col("user_id") % 100).cast("double").alias("no2"),
        (F.col("event_id") % 17).cast("double").alias("so2"),
        (F.col("event_id") % 29).cast("double").alias("o3"),
        F.col("value").alias("aqi"),
        *extra,
    )


def dimension(spark: SparkSession) -> DataFrame:
    return station_dimension(spark, DIMENSION)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and show timestamps without zone, as the SQL side does."""
    shown = []
    for field in df.schema:
        kind = field.dataType.typeName()
        column = F.col(field.name)
        if kind == "double":
            column = F.round(column, digits)
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        shown.append(column.alias(field.name))
    return df.select(*shown)


READINGS_SQL = """readings AS (
  SELECT event_type AS location_id,
         upper(event_type[1]) || event_type[2:] AS location_name,
         CASE event_type WHEN 'click' THEN 10.0 WHEN 'error' THEN 16.0 WHEN 'purchase' THEN 21.0 ELSE 0.0 END::DOUBLE AS latitude,
         100.0::DOUBLE AS longitude,
         ts AS "timestamp",
         value AS pm25,
         value + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pm10,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS co,
         CAST(user_id % 100 AS DOUBLE) AS no2,
         CAST(event_id % 17 AS DOUBLE) AS so2,
         CAST(event_id % 29 AS DOUBLE) AS o3,
         value AS aqi,
         event_id
  FROM events)"""

HOURLY_SQL = """hourly AS (
  SELECT location_id, location_name, date_trunc('hour', "timestamp") AS "timestamp",
         """ + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + """, count(*) AS readings
  FROM readings GROUP BY ALL)"""
