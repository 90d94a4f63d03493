"""Schemas of the tables that cross the library's boundary."""

from __future__ import annotations

from pyspark.sql import types as T

from sensorcast.config import MEASURES


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType()) for name in names]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


READING_SCHEMA = T.StructType(
    _strings("location_id", "location_name")
    + _doubles("latitude", "longitude")
    + [T.StructField("timestamp", T.TimestampType())]
    + _doubles(*MEASURES)
)

# Readings as a stream lands them: partitioned by date, so that a time range is a list of folders.
DATE = "reading_date"
# The time of landing tells which of several versions of a reading came last.
LANDED_AT = "ingested_at"
# Within a landing, the offset in the source does.
SOURCE_OFFSET = "source_offset"
SOURCE_POSITION = (T.StructField("source_partition", T.IntegerType()), T.StructField(SOURCE_OFFSET, T.LongType()))
LANDED_SCHEMA = T.StructType(
    [
        *READING_SCHEMA.fields,
        T.StructField(LANDED_AT, T.TimestampType()),
        *SOURCE_POSITION,
        T.StructField(DATE, T.DateType()),
    ]
)
# Rejects lie beside the readings, in a folder per reason; readings have none.
REJECT = "reject_reason"
REJECTED_TEXT = "rejected_text"
LANDED_OR_REJECTED = T.StructType(
    [*LANDED_SCHEMA.fields[:-1], *[T.StructField(n, T.StringType()) for n in (REJECTED_TEXT, REJECT)], LANDED_SCHEMA[DATE]]
)

# Readings as they arrive in text form. Everything is a string, so that one malformed field cannot
# turn a whole record into nulls without a trace.
RAW_READING_SCHEMA = T.StructType(_strings(*READING_SCHEMA.names))

# Field names of the weather service's hourly block, and the measure each one feeds.
PAYLOAD_FIELDS = {
    "pm2_5": "pm25",
    "pm10": "pm10",
    "carbon_monoxide": "co",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "european_aqi": "aqi",
}

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in PAYLOAD_FIELDS]
            ),
        )
    ]
)

GEOJSON_SCHEMA = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(T.StructType([T.StructField("properties", T.StructType(_strings("shapeISO")))])),
        )
    ]
)

# A forecast as the scoring stream stores it: the time of scoring, and the number of the feature row's
# version where a correction makes a new one, tell which of several forecasts is the last. They lie in a
# folder per date of the reading.
SCORED_AT = "scored_at"
REVISION = "revision"
FORECAST_DATE = "forecast_date"
FORECAST_SCHEMA = T.StructType(
    _strings("location_id", "location_name")
    + [T.StructField("timestamp", T.TimestampType())]
    + _doubles("pm25", "aqi", "predicted_pm25")
    + [T.StructField("horizon_hours", T.IntegerType()), T.StructField("forecast_for", T.TimestampType())]
)
STORED_FORECAST_SCHEMA = T.StructType(
    [
        *FORECAST_SCHEMA.fields,
        T.StructField(REVISION, T.LongType()),
        T.StructField(SCORED_AT, T.TimestampType()),
        T.StructField(FORECAST_DATE, T.DateType()),
    ]
)
MODEL_VERSION = "model_version"
VERSIONED_FORECAST_SCHEMA = T.StructType([*STORED_FORECAST_SCHEMA.fields, T.StructField(MODEL_VERSION, T.StringType())])
