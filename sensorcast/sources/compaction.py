"""Small files of a stream, rewritten as large ones.

A stream's sink writes at least one file per folder and micro-batch and its log says which files count, so they cannot be
replaced where they lie. Compaction writes the rows of whole folders to a table of its own, in files of a stated number of
rows, together with the names of the files it took in, and one commit makes both count at once. Readers
take the last committed generation of each folder and, from the sink, the files that no commit names: at any time every
row once, also while a compaction runs, after one that died, and for rows that land in a folder later.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorcast.config import TIME
from sensorcast.schema import DATE, LANDED_OR_REJECTED, REJECT
from sensorcast.sources import published
from sensorcast.staging import path_exists

RUN_ID = "compaction"
ROWS_PER_FILE = 2_000_000
_TAKEN = T.StructType([T.StructField("folder", T.StringType()), T.StructField("file", T.StringType())])


def _rows_path(path: str) -> str:
    return f"{path}/rows"


def _taken(spark: SparkSession, path: str) -> DataFrame:
    """Folder, file, generation and attempt of all that committed compactions took in."""
    stored = f"{path}/taken"
    if not path_exists(spark, stored):
        return spark.createDataFrame([], T.StructType([*_TAKEN.fields, *published.PLACE.fields]))
    named = spark.read.schema(T.StructType([*_TAKEN.fields, *published.PLACE.fields])).parquet(stored)
    counted = published.commits(spark, _rows_path(path)).select(*published.PLACE.names)
    return named.join(counted, published.PLACE.names, "left_semi")


def _folders(spark: SparkSession, path: str, taken: DataFrame) -> dict[str, str]:
    """Where the last generation of each compacted folder lies."""
    last = taken.groupBy("folder").agg(F.max(F.struct(published.BATCH, published.ATTEMPT)).alias("_last"))
    return {
        r["folder"]: published.attempt_path(_rows_path(path), RUN_ID, r["_last"][published.BATCH], r["_last"][published.ATTEMPT])
        for r in last.collect()
    }


def _pending(spark: SparkSession, landed: str, taken: DataFrame, schema: T.StructType, depth: int) -> dict[str, list[str]]:
    """Files of the sink that no compaction took in, by folder; names are below ``landed``. Spark's own file index
    has the names, from the sink's log where there is one; no file is opened."""
    if not path_exists(spark, landed):
        return {}
    files = [unquote(f).split("/")[-depth - 1 :] for f in spark.read.schema(schema).parquet(landed).inputFiles()]
    listed = spark.createDataFrame([("/".join(f[:-1]), "/".join(f)) for f in files], _TAKEN)
    found = defaultdict(list)
    for r in listed.join(taken, ["folder", "file"], "left_anti").collect():
        found[r["folder"]].append(r["file"])
    return found


def _read(spark: SparkSession, schema: T.StructType, base: str, paths: Sequence[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.names)


def _compacted(spark, path, schema, folders: dict[str, str]) -> DataFrame:
    return _read(spark, schema, _rows_path(path), [f"{at}/{folder}" for folder, at in sorted(folders.items())])


def compact(
    spark: SparkSession,
    landed: str,
    path: str,
    schema: T.StructType = LANDED_OR_REJECTED,
    partition_by: Sequence[str] = (REJECT, DATE),
    rows_per_file: int = ROWS_PER_FILE,
    min_files: int = 2,
    sort_by: str = TIME,
) -> list[str]:
    """Rewrite the folders of ``landed`` that have at least ``min_files`` files not yet taken in; returns their names.

    A folder is rewritten as a whole, with its last generation. Rows are spread by range, so that a folder with most of
    them is cut into many files and small ones share a task, and are sorted by time within a file. Older generations
    and the sink's files stay where they are, as running readers and the sink's log name them.
    Of two compactions that run at once the first to commit counts; the other's files are never read.
    """
    taken = _taken(spark, path)
    done = _folders(spark, path, taken)
    pending = _pending(spark, landed, taken, schema, len(partition_by))
    due = sorted(folder for folder, files in pending.items() if len(files) >= min_files)
    if not due:
        return []
    last = taken.agg(F.max(published.BATCH)).first()[0]
    generation = 0 if last is None else last + 1
    files = [f for folder in due for f in pending[folder]]
    fresh = _read(spark, schema, landed, [f"{landed}/{f}" for f in files])
    older = _compacted(spark, path, schema, {f: done[f] for f in due if f in done})
    rows = fresh.unionByName(older)
    parts = max(1, -(-rows.count() // rows_per_file))  # the count is in the files' footers
    order = [*partition_by, sort_by]
    sized = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    attempt = published.write_attempt(sized, _rows_path(path), RUN_ID, generation, partition_by)
    names = spark.createDataFrame([(folder, f) for folder in due for f in pending[folder]], _TAKEN)
    place = {published.RUN: F.lit(RUN_ID), published.BATCH: F.lit(generation).cast("long"), published.ATTEMPT: F.lit(attempt)}
    placed = names.coalesce(1).withColumns(place)
    placed.write.mode("append").partitionBy(*published.PLACE.names).parquet(f"{path}/taken")
    published.commit(spark, _rows_path(path), RUN_ID, generation, attempt)
    return due


def read_compacted(
    spark: SparkSession,
    landed: str,
    path: str,
    schema: T.StructType = LANDED_OR_REJECTED,
    partition_by: Sequence[str] = (REJECT, DATE),
) -> DataFrame:
    """All rows of ``landed``, from compacted files where there are some. Filters on the partition columns leave out
    folders of either kind. ``readers.accepted_rows`` gives the readings among them."""
    taken = _taken(spark, path)
    pending = _pending(spark, landed, taken, schema, len(partition_by))
    fresh = _read(spark, schema, landed, [f"{landed}/{f}" for files in pending.values() for f in files])
    return _compacted(spark, path, schema, _folders(spark, path, taken)).unionByName(fresh)
