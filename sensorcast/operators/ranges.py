"""Aggregates over a time range before each row, for stations with very many readings in it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _partial(value: Column) -> list[Column]:
    """What two stretches of rows can be merged from."""
    return [F.count(value), F.sum(value), F.min(value), F.max(value)]


_PARTS = ("rows", "sum", "min", "max")


def range_aggregates(
    df: DataFrame,
    measure: str,
    since: timedelta,
    until: timedelta,
    slot: timedelta | None = None,
    keys: Sequence[str] = (STATION,),
) -> DataFrame:
    """All rows of ``df`` with ``range_rows``, ``range_sum``, ``range_mean``, ``range_min`` and ``range_max`` of the
    measure over the readings of the same keys from ``since`` to ``until`` before the row's time, both ends included
    (``until`` may be negative, for readings after it). Null values do not count. A row
    whose range has no values has 0 rows and nulls else, and so has one without a time; null keys are a key.

    A window frame adds up its whole range for every row, and needs it in one task. Here time is cut into
    slots, at most as long as the range, by default a sixtieth of it: a range is the end of one slot,
    whole slots, and the beginning of another. The whole ones are added up in a table with a row per slot; the ends come
    from running sums within a slot, where the readings meet the instants at which ranges begin and end.
    So no task has to hold more than a slot of one station, however dense it is, and work grows with the rows and not with
    the rows times those in range.
    """
    length = _micros(since) - _micros(until)
    width = max(1, length // 60) if slot is None else _micros(slot)
    if not 0 < width <= length:
        raise ValueError("slots must be longer than nothing and not longer than the range")
    names = [f"_key{i}" for i in range(len(keys))]
    place = [*names, "_slot"]
    slot_of = lambda instant: ((instant - F.pmod(instant, F.lit(width))) / F.lit(width)).cast("long")
    at = F.unix_micros(F.col(TIME).cast("timestamp"))
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], at.alias("_at"), F.col(f"`{measure}`").cast("double").alias("_value"))
    rows = rows.filter(F.col("_at").isNotNull())
    # Readings of one instant have the same range: it is looked up once.
    asked = rows.select(*names, "_at").distinct()
    held = rows.select(*names, F.col("_at").alias("_instant"), F.lit(None).cast("long").alias("_for"), "_value")
    here = Window.partitionBy(*place)
    value = F.col("_value")

    def meeting(before: timedelta) -> DataFrame:
        """The readings and the instants so long before those asked for, with their slots."""
        instant = (F.col("_at") - F.lit(_micros(before))).alias("_instant")
        points = asked.select(*names, instant, F.col("_at").alias("_for"), F.lit(None).cast("double").alias("_value"))
        return held.unionByName(points).withColumn("_slot", slot_of(F.col("_instant")))

    def running(met: DataFrame, order: Column) -> DataFrame:
        """What the readings of an instant's slot up to it come to, in this order; readings at the very instant included.
        All in one window: a task holds one sort of its slots."""
        upto = here.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = {name: part.over(upto) for name, part in zip(_PARTS, _partial(value))}
        return met.withColumns(sums).filter(F.col("_for").isNotNull())

    # The end of the first slot and the beginning of the last.
    first = running(meeting(since), F.col("_instant").desc()).select(*names, "_for", *_PARTS)
    ends = meeting(until)
    last = running(ends, F.col("_instant").asc())

    # A range has one of two numbers of whole slots.
    fewest = length // width - 1
    slots = ends.groupBy(*place).agg(*[p.alias(f"_{n}") for n, p in zip(_PARTS, _partial(value))])
    merge = {"rows": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    series = Window.partitionBy(*names).orderBy("_slot")
    for whole in (fewest, fewest + 1):
        parts = [
            (merge[n](f"_{n}").over(series.rangeBetween(-whole, -1)) if whole else F.lit(None)).cast("long" if n == "rows" else "double").alias(n)
            for n in _PARTS
        ]
        slots = slots.withColumn(f"_whole{whole}", F.struct(*parts))
    slots = slots.select(*[F.col(c).alias(f"_s{c}") for c in place], f"_whole{fewest}", f"_whole{fewest + 1}")
    match = F.lit(True)
    for c in place:
        match = match & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    last = last.join(slots, match)
    number = F.col("_slot") - slot_of(F.col("_for") - F.lit(_micros(since))) - 1
    between = F.when(number == fewest, F.col(f"_whole{fewest}")).otherwise(F.col(f"_whole{fewest + 1}"))
    inner = last.select(*names, "_for", F.inline(F.array(F.struct(*_PARTS), between)))
    found = inner.unionByName(first).groupBy(*names, "_for").agg(*[merge[n](n).alias(f"range_{n}") for n in _PARTS])

    own = F.unix_micros(F.col(TIME).cast("timestamp")) == F.col("_for")
    for k, n in zip(keys, names):
        own = own & F.col(f"`{k}`").eqNullSafe(F.col(n))
    counted = F.coalesce("range_rows", F.lit(0)).alias("range_rows")
    mean = F.when(F.col("range_rows") > 0, F.col("range_sum") / F.col("range_rows")).alias("range_mean")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.join(found, own, "left").select(*kept, counted, "range_sum", mean, "range_min", "range_max")
