"""Window functions over series that are too long for one task.

``Window.partitionBy(station)`` puts a whole station into one task. Where one station holds a large
part of the table that task decides the run time, and adaptive execution does not split windows. So
stations above a row limit are cut into time chunks, and the window runs per (station, chunk). Each
chunk also receives copies of the few neighbouring rows its windows reach into (the halo); the
copies are dropped after the window, so the result equals the unsplit one.

Stations below the limit keep a single chunk, -1, and need no copies.

Rows that share station and timestamp cannot be told apart by time and stay together: remove
repeats with ``keep_last`` first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME, Chunking

CHUNK = "_chunk"
HALO = "_halo"
_WHOLE = -1
# Chunk number = coarse cell * _FINE + part of the cell, so that numbers grow with time.
_FINE = 1_000_000


def _micros() -> Column:
    return F.unix_micros(F.col(TIME))


def _slice(low: str, width: str) -> Column:
    return F.expr(f"(unix_micros({TIME}) - {low}) div {width}")


def _oversized(df: DataFrame, keys: list[str], chunking: Chunking, min_width: int = 0) -> DataFrame:
    """Groups of ``keys`` with more rows than one chunk: first instant, width of the equal time
    slices to cut each one into, and number of the last slice.

    One pass over keys and time with map-side aggregation. The unit grows with the table, so at most
    ``max_chunks`` groups can exceed it: this table stays small whatever the input size.
    """
    # The total needs no columns, so a Parquet scan reads footers only.
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    unit = F.greatest(F.lit(chunking.rows_per_chunk), F.ceil(total / F.lit(chunking.max_chunks)))
    spans = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(_micros()).alias("low"), F.max(_micros()).alias("high")
    )
    even = F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / unit))
    return (
        spans.filter((F.col("n") > unit) & (F.col("high") > F.col("low")))
        .select(*keys, "low", "high", F.greatest(even, F.lit(max(min_width, 1))).alias("width"))
        .select(*keys, "low", "width", F.expr("(high - low) div width").alias("last"))
    )


@dataclass(frozen=True)
class Cuts:
    """Where the long stations of a table are cut, in two steps. Equal slices of a station's time
    span first; slices that still hold too many rows, because the readings come in bursts, are then
    cut again. Any cuts give the same results; these make the chunks even."""

    stations: DataFrame
    bursts: DataFrame | None

    def place(self, df: DataFrame, long_only: bool = False) -> DataFrame:
        """Add the chunk number; ``long_only`` keeps just the stations that are split."""
        kind = "inner" if long_only else "left"
        placed = df.join(F.broadcast(self.stations), STATION, kind).withColumn("_cell", _slice("_low", "_width"))
        part = F.lit(0)
        if self.bursts is not None:
            placed = placed.join(F.broadcast(self.bursts), [STATION, "_cell"], "left")
            part = F.coalesce(_slice("_low2", "_width2"), F.lit(0))
        number = F.col("_cell") * F.lit(_FINE) + part
        return placed.withColumn(CHUNK, F.coalesce(number, F.lit(_WHOLE).cast("long"))).select(*df.columns, CHUNK)


def _held(df: DataFrame, suffix: str = "") -> DataFrame | None:
    """The rows of a table of cuts as local data, or None if there are none. Their number is bounded
    (see ``_oversized``), and holding them keeps the pass that found them out of the later plan."""
    rows = df.collect()
    if not rows:
        return None
    names = {n: f"_{n}{suffix}" for n in ("low", "width", "last")}
    return df.sparkSession.createDataFrame(rows, df.schema).withColumnsRenamed(names)


def measure_cuts(df: DataFrame, chunking: Chunking, min_width: int = 0) -> Cuts | None:
    """Look for long stations, and for bursts in those; None if no station needs to be split. This
    runs a job over the station and time columns, the only one that chunking starts."""
    narrow = df.select(STATION, TIME)
    stations = _held(_oversized(narrow, [STATION], chunking, min_width))
    if stations is None:
        return None
    if min_width:
        return Cuts(stations, None)
    cells = narrow.join(F.broadcast(stations), STATION).withColumn("_cell", _slice("_low", "_width"))
    return Cuts(stations, _held(_oversized(cells, [STATION, "_cell"], chunking), suffix="2"))


def _unsplit(df: DataFrame) -> DataFrame:
    return df.withColumn(CHUNK, F.lit(_WHOLE).cast("long"))


def with_chunks(df: DataFrame, chunking: Chunking | None) -> DataFrame:
    """Add the chunk number only, for functions that need no neighbours. ``None`` leaves every
    station whole, which suits series known to be short, such as a micro-batch with its history."""
    cuts = measure_cuts(df, chunking) if chunking else None
    return cuts.place(df) if cuts else _unsplit(df)


def chunk_window() -> Window:
    return Window.partitionBy(STATION, CHUNK).orderBy(TIME)


def _edge_copies(split: DataFrame, size: int, backward: bool) -> DataFrame:
    """Copies of the ``size`` rows nearest to each chunk from the chunks before (or after) it.

    Only the outermost rows of a chunk can be needed elsewhere; picking them by row number lets
    Spark discard all others before the shuffle. A short chunk does not fill the need of its
    neighbour, so the search goes on over the sequence of picked rows, not just one chunk away.
    """
    order = F.col(TIME).desc() if backward else F.col(TIME).asc()
    outer = Window.partitionBy(STATION, CHUNK).orderBy(order)
    picked = split.withColumn("_n", F.row_number().over(outer)).filter(F.col("_n") <= size).drop("_n")
    along = Window.partitionBy(STATION).orderBy(CHUNK, TIME)
    reach = along.rowsBetween(1, size) if backward else along.rowsBetween(-size, -1)
    return (
        picked.withColumn("_near", F.collect_set(CHUNK).over(reach))
        .withColumn("_to", F.explode(F.array_remove("_near", F.col(CHUNK))))
        .drop("_near", CHUNK)
        .withColumnRenamed("_to", CHUNK)
    )


def with_row_halo(
    df: DataFrame, values: list[str], before: int, after: int, chunking: Chunking | None
) -> DataFrame:
    """Chunked rows plus copies so that frames of ``before`` / ``after`` rows are complete.

    ``values`` are the columns the windows read; copies carry no others.
    """
    cuts = measure_cuts(df, chunking) if chunking else None
    if cuts is None:
        return _unsplit(df).withColumn(HALO, F.lit(False))
    out = cuts.place(df).withColumn(HALO, F.lit(False))
    narrow = df.select(STATION, TIME, *[v for v in values if v not in (STATION, TIME)])
    for size, backward in ((before, True), (after, False)):
        if size > 0:
            copies = _edge_copies(cuts.place(narrow, long_only=True), size, backward)
            out = out.unionByName(copies.withColumn(HALO, F.lit(True)), allowMissingColumns=True)
    return out


def with_time_halo(df: DataFrame, before: int, after: int, chunking: Chunking | None) -> DataFrame:
    """Chunked rows plus copies so that frames of ``before`` / ``after`` microseconds are complete.

    Chunks are at least as wide as the longer reach, so a row is copied into at most one chunk on
    either side, and all copies are made in place, without another pass.
    """
    cuts = measure_cuts(df, chunking, min_width=max(before, after, 1)) if chunking else None
    if cuts is None:
        return _unsplit(df).withColumn(HALO, F.lit(False))
    placed = df.join(F.broadcast(cuts.stations), STATION, "left")
    own = F.coalesce(_slice("_low", "_width"), F.lit(_WHOLE).cast("long"))
    at = _micros() - F.col("_low")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - F.lit(after)) / F.col("_width")))
    last = F.least(F.col("_last"), F.floor((at + F.lit(before)) / F.col("_width")))
    targets = F.when(F.col("_own") < 0, F.array("_own")).otherwise(F.sequence(first, last))
    return (
        placed.withColumn("_own", own)
        .withColumn(CHUNK, F.explode(targets))
        .withColumn(HALO, F.col(CHUNK) != F.col("_own"))
        .drop("_own", "_low", "_width", "_last")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO)


def with_series_rank(df: DataFrame, chunking: Chunking | None, labels: Sequence[str] = ()) -> DataFrame:
    """Add ``series_rank`` (1 for a station's oldest row) and ``series_rows`` (its row count), and for each of
    ``labels`` ``missing_<label>`` (nulls of it up to and with this row) and ``present_<label>`` (the station's
    rows that have it).

    Within a chunk all come from one window; for split stations those of earlier chunks are
    added from a table of chunk sizes, which the chunking bounds. A chunk column already present is
    used, and so is its partitioning.
    """
    chunked = df if CHUNK in df.columns else with_chunks(df, chunking)
    so_far = chunk_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(STATION, CHUNK)
    # Counts up to a row, with the name of the result, and counts of the whole series.
    running = {"series_rank": F.row_number().over(chunk_window()).cast("long")}
    running |= {f"missing_{n}": F.count_if(F.col(n).isNull()).over(so_far) for n in labels}
    totals = {"series_rows": F.count(F.lit(1)).over(whole)} | {f"present_{n}": F.count(n).over(whole) for n in labels}
    local = chunked.withColumns(running | totals)
    along = Window.partitionBy(STATION).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    station = Window.partitionBy(STATION)
    inside = {"series_rank": F.col("series_rows")}
    inside |= {f"missing_{n}": F.col("series_rows") - F.col(f"present_{n}") for n in labels}
    sizes = (
        chunked.filter(F.col(CHUNK) >= 0)
        .groupBy(STATION, CHUNK)
        .agg(F.count(F.lit(1)).alias("series_rows"), *[F.count(n).alias(f"present_{n}") for n in labels])
        .select(
            STATION,
            CHUNK,
            *[F.sum(count).over(along).alias(f"_before_{n}") for n, count in inside.items()],
            *[F.sum(n).over(station).alias(f"_all_{n}") for n in totals],
        )
    )
    added = {n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in running}
    added |= {n: F.coalesce(f"_all_{n}", n) for n in totals}
    helpers = [f"_before_{n}" for n in running] + [f"_all_{n}" for n in totals]
    return local.join(F.broadcast(sizes), [STATION, CHUNK], "left").withColumns(added).drop(*helpers)
