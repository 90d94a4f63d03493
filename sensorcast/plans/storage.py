"""What a table costs in different file formats."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorcast.staging import scratch_path


def compare_formats(
    df: DataFrame, column: str, formats: tuple[str, ...] = ("csv", "parquet"), repeats: int = 3
) -> DataFrame:
    """Write ``df`` in each format and measure files, bytes, and the shortest time to average one
    column. ``rows`` and ``mean`` are what a scan of each format found, to tell that they hold the same."""
    spark = df.sparkSession
    rows = None
    for name in formats:
        path = scratch_path(spark, f"format-{name}")
        options = {"header": True} if name == "csv" else {}
        df.write.format(name).options(**options).save(path)
        table = spark.read.schema(df.schema).format(name).options(**options).load(path)
        times = []
        for _ in range(repeats):
            start = time.perf_counter()
            found = table.agg(F.count("*").alias("rows"), F.avg(column).alias("mean")).first()
            times.append(time.perf_counter() - start)
        # File lengths come from the listing; the contents are not read.
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length")
        row = files.agg(
            F.lit(name).alias("format"),
            F.count("length").alias("files"),
            F.sum("length").alias("bytes"),
            F.lit(min(times)).alias("scan_seconds"),
            F.lit(found["rows"]).cast("long").alias("rows"),
            F.lit(found["mean"]).cast("double").alias("mean"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows
