"""Intermediate tables in storage that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``. A local session without one gets a
    temporary folder; on a cluster the setting is required, as local disks are lost with their host."""
    named = spark.conf.get(_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {_CONF} to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="sensorcast-")
    spark.conf.set(_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever storage it names."""
    try:
        spark.read.schema("value string").text(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def ensure_table(spark: SparkSession, path: str, schema: StructType, partitions: list[str]) -> None:
    """Make ``path`` an empty table if there is nothing yet, so that a stream can start reading it
    before the first rows arrive."""
    if not path_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage is cut, losing an
    executor costs nothing upstream, and each later pass reads only the columns it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
