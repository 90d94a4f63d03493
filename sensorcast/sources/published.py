"""Batches that count once they are named in a commit table.

Writing a folder is not one step: a job that dies while its files are moved into place leaves some of them, in most
stores visible. So a batch is written to a folder of its own attempt, and then one row in one file names
that attempt. Readers take the rows of named attempts only; a replay writes another attempt, and of two that were
named for one batch the first counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorcast.staging import path_exists

RUN, BATCH, ATTEMPT = "run_id", "batch_id", "attempt"
PLACE = T.StructType([T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType()), T.StructField(ATTEMPT, T.StringType())])
COMMIT_SCHEMA = T.StructType([*PLACE.fields, T.StructField("committed_at", T.TimestampType())])


def _commits_path(path: str) -> str:
    return f"{path}/_commits"  # not read as data


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The attempt that counts of every published batch."""
    if not path_exists(spark, _commits_path(path)):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    named = spark.read.schema(COMMIT_SCHEMA).parquet(_commits_path(path))
    first = F.min(F.struct("committed_at", ATTEMPT)).alias("_first")
    return named.groupBy(RUN, BATCH).agg(first).select(RUN, BATCH, f"_first.{ATTEMPT}", "_first.committed_at")


def is_published(spark: SparkSession, path: str, run_id: str, batch_id: int) -> bool:
    return not commits(spark, path).filter((F.col(RUN) == run_id) & (F.col(BATCH) == batch_id)).isEmpty()


def write_attempt(df: DataFrame, path: str, run_id: str, batch_id: int, partition_by: Sequence[str] = ()) -> str:
    """Write rows that no reader sees yet; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    placed = df.withColumns({RUN: F.lit(run_id), BATCH: F.lit(batch_id).cast("long"), ATTEMPT: F.lit(attempt)})
    placed.write.mode("append").partitionBy(*PLACE.names, *partition_by).parquet(path)
    return attempt


def attempt_path(path: str, run_id: str, batch_id: int, attempt: str) -> str:
    return f"{path}/{RUN}={run_id}/{BATCH}={batch_id}/{ATTEMPT}={attempt}"


def commit(spark: SparkSession, path: str, run_id: str, batch_id: int, attempt: str) -> None:
    row = spark.createDataFrame([(run_id, batch_id, attempt)], PLACE).withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(_commits_path(path))


def publish_batch(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Add a batch to the table at ``path`` as a whole; one that is published already is left alone."""
    spark = df.sparkSession
    if not is_published(spark, path, run_id, batch_id):
        commit(spark, path, run_id, batch_id, write_attempt(df, path, run_id, batch_id))


def read_published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all published batches, with their run and batch. Attempts are folders, so the join with the commit
    table can leave out those that do not count before they are read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, *PLACE.fields[:2]]))
    rows = spark.read.schema(T.StructType([*schema.fields, *PLACE.fields])).parquet(path)
    return rows.join(commits(spark, path).select(*PLACE.names), PLACE.names, "left_semi").drop(ATTEMPT)


def read_newest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the batch that was published last, for tables that each batch writes as a whole."""
    last = commits(spark, path).orderBy(F.col("committed_at").desc(), F.col(BATCH).desc()).first()
    if last is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(attempt_path(path, last[RUN], last[BATCH], last[ATTEMPT]))
