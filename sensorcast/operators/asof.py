"""As-of joins: for many instants per station the reading at, before, after or nearest to each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME, Chunking
from sensorcast.operators import chunks

DIRECTIONS = ("nearest", "before", "after")


def asof_join(
    instants: DataFrame,
    readings: DataFrame,
    direction: str = "nearest",
    tolerance_seconds: float | None = None,
    into: str = "near",
    chunking: Chunking | None = Chunking(),
) -> DataFrame:
    """Every row of ``instants`` (with station and timestamp) and, as struct ``into``, the reading of its station
    that is nearest in time, of two equally near ones the earlier; or the last one ``before`` or at it, or the first one
    ``after`` or at it. It is null where there is none within the tolerance.

    Both tables go through two windows per station, forward and backward in time, in which each instant sees the last
    reading so far and the first one to come. Both frames only grow, so that work grows with the rows. Long stations are cut into time chunks. What an instant at
    a chunk's edge sees then lies in another chunk, however far away: the first and last reading of
    each chunk are carried along a table of chunks, whose size the chunking bounds, and joined back.

    Instants without station or time match nothing. Readings should have one row per station and instant
    (``keep_last``); of several any one is taken.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}, not {direction!r}")
    if into in instants.columns:
        raise ValueError(f"{into} is a column already")
    # Both sides as (station, time, asked, found): the rows of one side are null on the other.
    asked = instants.select(STATION, TIME, F.struct(*instants.columns).alias("_asked"))
    known = readings.filter(F.col(STATION).isNotNull() & F.col(TIME).isNotNull())
    known = known.select(STATION, TIME, F.struct(*readings.columns).alias("_found"))
    placeable = F.col(STATION).isNotNull() & F.col(TIME).isNotNull()
    both = known.unionByName(asked.filter(placeable), allowMissingColumns=True)

    chunked = chunks.with_chunks(both, chunking)
    place = Window.partitionBy(STATION, chunks.CHUNK)
    # Frames by range, so that a reading at the instant itself is seen from both sides. A frame that shrinks
    # with each row (the rows to come) would be read anew for every one: those are the rows so far, backward in time.
    forward = place.orderBy(TIME).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backward = place.orderBy(F.col(TIME).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    newest = F.last("_found", ignorenulls=True)
    seen = chunked.withColumns({"_before": newest.over(forward), "_after": newest.over(backward)})
    seen = seen.filter(F.col("_asked").isNotNull())

    split = chunked.filter((F.col(chunks.CHUNK) >= 0) & F.col("_found").isNotNull())
    edges = split.groupBy(STATION, chunks.CHUNK).agg(
        F.max_by("_found", TIME).alias("_last"), F.min_by("_found", TIME).alias("_first")
    )
    # Chunks that hold instants but no reading need their neighbours' too.
    places = chunked.filter(F.col(chunks.CHUNK) >= 0).select(STATION, chunks.CHUNK).distinct()
    along = Window.partitionBy(STATION).orderBy(chunks.CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(STATION).orderBy(F.col(chunks.CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = places.join(edges, [STATION, chunks.CHUNK], "left").select(
        STATION,
        chunks.CHUNK,
        F.last("_last", ignorenulls=True).over(along).alias("_earlier"),
        F.last("_first", ignorenulls=True).over(back).alias("_later"),
    )
    whole = seen.join(F.broadcast(carried), [STATION, chunks.CHUNK], "left")
    before, after = F.coalesce("_before", "_earlier"), F.coalesce("_after", "_later")
    chosen = {"before": before, "after": after, "nearest": _nearer(before, after)}[direction]
    if tolerance_seconds is not None:
        close = _apart(chosen) <= F.lit(round(tolerance_seconds * 1_000_000))
        chosen = F.when(close, chosen)
    found = whole.select("_asked.*", chosen.alias(into))
    nothing = F.lit(None).cast(found.schema[into].dataType).alias(into)
    return found.unionByName(instants.filter(~placeable).select("*", nothing))


def _apart(reading: Column) -> Column:
    return F.abs(F.unix_micros(reading[TIME]) - F.unix_micros(F.col(TIME)))


def _nearer(before: Column, after: Column) -> Column:
    return F.when(after.isNull() | (_apart(before) <= _apart(after)), before).otherwise(after)
