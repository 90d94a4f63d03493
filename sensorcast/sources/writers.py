"""Batch sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorcast.config import STATION


RUN_COLUMNS = (T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType()))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def batch_path(path: str, run_id: str, batch_id: int) -> str:
    return f"{path}/run_id={run_id}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Add a micro-batch to the table at ``path``. A replayed batch replaces its own earlier output
    and nothing else, so the table holds each batch once."""
    (
        df.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("long")})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "batch_id")
        .parquet(path)
    )


def to_messages(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows as JSON text in ``value``, keyed by station: what a message topic takes."""
    key = F.col(STATION) if key is None else key
    text = F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return df.select(key.cast("string").alias("key"), text.alias("value"))


def write_messages(df: DataFrame, options: dict[str, str]) -> None:
    """Send rows to a Kafka topic. ``options`` names servers and topic; needs the Kafka connector."""
    to_messages(df).write.format("kafka").options(**options).save()
