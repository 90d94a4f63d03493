"""What a table of readings contains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorcast.config import MEASURES, STATION, TIME, Chunking
from sensorcast.operators import chunks
from sensorcast.operators.clean import Bounds, outside


def profile(df: DataFrame, measures: Sequence[str] = MEASURES, bounds: Bounds | None = None) -> DataFrame:
    """One row: rows, stations, repeated keys, time range, nulls and out-of-range values.

    Only the key columns are shuffled, to find repeats; all other facts fold into one row per task.
    """
    facts = {f"{m}_null": F.count_if(F.col(m).isNull() | F.isnan(m)) for m in measures}
    facts |= {f"{m}_out": F.count_if(outside(F.col(m), *b)) for m, b in (bounds or {}).items()}
    keys = df.groupBy(STATION, TIME).agg(F.count(F.lit(1)).alias("copies"))
    stations = df.groupBy(STATION).agg(F.lit(1).alias("one")).agg(F.count(STATION).alias("n"))
    repeated = keys.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(TIME).alias("first_time"),
        F.max(TIME).alias("last_time"),
        *[e.alias(n) for n, e in facts.items()],
    ).withColumns({"stations": stations.scalar(), "repeated_keys": repeated.scalar()})


def cadence(df: DataFrame, chunking: Chunking | None = Chunking()) -> DataFrame:
    """How many readings follow the one before by how many whole seconds."""
    before = F.lag(TIME).over(chunks.chunk_window())
    spaced = chunks.with_row_halo(df.select(STATION, TIME), [], 1, 0, chunking).withColumn("_before", before)
    step = F.unix_seconds(TIME) - F.unix_seconds("_before")
    return (
        chunks.drop_halo(spaced)
        .filter(F.col("_before").isNotNull())
        .groupBy(step.alias("step_seconds"))
        .agg(F.count(F.lit(1)).alias("readings"))
    )
