"""Forecasts meet the readings they foretold, as these arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorcast.config import HORIZONS, STATION, TIME
from sensorcast.operators.clean import keep_last
from sensorcast.schema import FORECAST_DATE, FORECAST_SCHEMA, LANDED_AT, REVISION, SCORED_AT, SOURCE_OFFSET, STORED_FORECAST_SCHEMA
from sensorcast.staging import ensure_table

ACTUAL = "actual_pm25"
ERROR_SCHEMA = T.StructType(
    [
        *FORECAST_SCHEMA.fields,
        T.StructField(REVISION, T.LongType()),
        T.StructField(SCORED_AT, T.TimestampType()),
        T.StructField(ACTUAL, T.DoubleType()),
        T.StructField(LANDED_AT, T.TimestampType()),
        T.StructField(SOURCE_OFFSET, T.LongType()),
        T.StructField(FORECAST_DATE, T.DateType()),
    ]
)


def stored_forecast_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Forecasts as ``score_stream`` stores them; nothing has to be there yet."""
    ensure_table(spark, path, STORED_FORECAST_SCHEMA, [FORECAST_DATE])
    return spark.readStream.schema(STORED_FORECAST_SCHEMA).options(**options).parquet(path)


def forecasts_with_actuals(
    forecasts: DataFrame, readings: DataFrame, lateness: str = "2 days", longest: int = max(HORIZONS)
) -> DataFrame:
    """Two streams joined: every version of a forecast with every version of the reading at its time.

    Either side may come first. A reading is due between one and ``longest`` hours after the reading that a forecast was
    made from; with a watermark on either side, which lags by ``lateness``, that range tells when a row can meet no
    other any more, and it leaves the state. Rows that are later than that are dropped.
    """
    made = forecasts.withWatermark(TIME, lateness).select(*FORECAST_SCHEMA.names, REVISION, SCORED_AT, FORECAST_DATE).alias("f")
    measured = readings.withWatermark(TIME, lateness).select(
        F.col(STATION).alias("_station"), F.col(TIME).alias("_measured"), F.col("pm25").alias(ACTUAL), LANDED_AT, SOURCE_OFFSET
    )
    same = (F.col(STATION) == F.col("_station")) & (F.col("forecast_for") == F.col("_measured"))
    due = (F.col("_measured") >= F.col(TIME)) & (F.col("_measured") <= F.col(TIME) + F.expr(f"INTERVAL {int(longest)} HOURS"))
    return made.join(measured, same & due).select(ERROR_SCHEMA.names)


def verification_stream(
    forecasts: DataFrame,
    readings: DataFrame,
    path: str,
    checkpoint: str,
    lateness: str = "2 days",
    longest: int = max(HORIZONS),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write ``forecasts_with_actuals`` to ``path``, in folders by date of the forecast."""
    joined = forecasts_with_actuals(forecasts, readings, lateness, longest)
    writer = joined.writeStream.format("parquet").outputMode("append").partitionBy(FORECAST_DATE)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Last forecasts with the last reading at their time and the error, as ``forecast_vs_actual`` gives them."""
    pairs = spark.read.schema(ERROR_SCHEMA).parquet(path)
    last = keep_last(pairs, [SCORED_AT, REVISION, LANDED_AT, SOURCE_OFFSET, "predicted_pm25", ACTUAL], (STATION, TIME, "horizon_hours"))
    return last.select(*FORECAST_SCHEMA.names, ACTUAL, (F.col(ACTUAL) - F.col("predicted_pm25")).alias("error"))
