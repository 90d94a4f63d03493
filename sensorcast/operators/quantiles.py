"""Exact quantiles of large columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.staging import stage


@dataclass(frozen=True)
class _Search:
    """The wanted value is the ``rank``-th smallest of the ``rows`` values in [low, high]. ``close``
    says that all of them have the same sign and binary exponent."""

    measure: str
    probability: float
    rank: int
    rows: int
    low: float
    high: float
    close: bool = False

    def values(self) -> Column:
        """The value where it lies in the interval, null elsewhere."""
        value = F.col(self.measure)
        return F.when(~F.isnan(value) & value.between(self.low, self.high), value)


def _long(df: DataFrame, searches: Sequence[_Search]) -> DataFrame:
    """One row per search and value in its interval."""
    columns = [
        F.struct(F.lit(i).alias("search"), s.values().alias("value"), F.lit(s.low).alias("low"),
                 F.lit(s.high).alias("high"), F.lit(s.rank).cast("long").alias("rank"), F.lit(s.close).alias("close"))
        for i, s in enumerate(searches)
    ]
    return df.select(F.inline(F.array(*columns))).filter(F.col("value").isNotNull())


def _magnitude(value: Column) -> Column:
    """A whole number that rises with the value and is equal for values of one sign and exponent."""
    size = F.abs(value)
    infinite = size == F.lit(float("inf"))
    exponent = F.when(infinite, F.lit(3000)).otherwise(F.floor(F.log2(size)).cast("int") + 1500)
    return F.when(value == 0, F.lit(0)).when(value < 0, -exponent).otherwise(exponent)


def _narrow(df: DataFrame, searches: Sequence[_Search], cells: int) -> list[_Search]:
    """Cut every interval into cells, count them, and keep the cell that holds the rank.

    The first cut is by sign and exponent, so infinite and very distant values cannot spoil it; the
    others are linear between values less than a factor of two apart, so each leaves one of ``cells``
    parts of what a double can tell apart: six passes for 4096 cells, whatever the values."""
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    linear = F.least(F.floor(share * cells), F.lit(cells - 1)).cast("int")
    cell = F.when(F.col("close"), linear).otherwise(_magnitude(F.col("value"))).alias("cell")
    # As many rows as there are cells, however large the table.
    counted = _long(df, searches).groupBy("search", "rank", cell).agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    upto = F.sum("rows").over(Window.partitionBy("search").orderBy("cell"))
    held = counted.withColumn("before", upto - F.col("rows")).filter(
        (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("rows"))
    )
    return [
        replace(
            searches[r["search"]], rank=r["rank"] - r["before"], rows=r["rows"], low=r["low"], high=r["high"], close=True
        )
        for r in held.collect()
    ]


def _pick(df: DataFrame, searches: Sequence[_Search]) -> list[_Search]:
    """Settle searches whose interval holds few rows, by counting equal values in order."""
    distinct = _long(df, searches).groupBy("search", "rank", "value").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("search").orderBy("value"))
    found = distinct.withColumn("upto", upto).filter(F.col("upto") >= F.col("rank"))
    rows = found.groupBy("search").agg(F.min("value").alias("value")).collect()
    return [replace(searches[r["search"]], low=r["value"], high=r["value"]) for r in rows]


def quantiles(
    df: DataFrame, measures: Sequence[str], probabilities: Sequence[float], cells: int = 4096, few: int = 1_000_000
) -> DataFrame:
    """Smallest value that at least the given share of a measure's values does not exceed: columns
    measure, probability, value. Nulls and NaN do not count; a measure without values has no rows.

    Sketches of a whole table meet in one task, whose work grows with the number of files. Here each
    pass over the table counts a fixed number of cells per quantile and goes on within one of them,
    until no more than ``few`` rows are left to sort.
    """
    spark = df.sparkSession
    number = lambda m: F.when(~F.isnan(m), F.col(m))
    facts = [e for m in measures for e in (F.count(number(m)), F.min(number(m)), F.max(number(m)))]
    found = list(df.agg(*[F.struct(*facts[i : i + 3]).alias(m) for i, m in zip(range(0, len(facts), 3), measures)]).first())
    open_, done = [], []
    for measure, (rows, low, high) in zip(measures, found):
        for p in probabilities:
            if rows:
                open_.append(_Search(measure, p, max(1, ceil(p * rows)), rows, low, high))
    while open_:
        done += [s for s in open_ if s.low == s.high]
        large = [s for s in open_ if s.low < s.high and s.rows > few]
        small = [s for s in open_ if s.low < s.high and s.rows <= few]
        open_ = (_narrow(df, large, cells) if large else []) + (_pick(df, small) if small else [])
    rows = sorted((s.measure, float(s.probability), float(s.low)) for s in done)
    return spark.createDataFrame(rows, "measure string, probability double, value double")


def _order(value: Column) -> Column:
    """A long that is in the same order as the values, equal for equal ones: the bits of the double, negated for values
    below zero. Both zeros are 0."""
    size = F.abs(value)
    two_to = lambda exponent: F.pow(F.lit(2.0), exponent.cast("double"))
    near = F.floor(F.log2(size)).cast("int")  # the logarithm may be off by one just below a power of two
    exact = F.when(size < two_to(near), near - 1).when(size >= two_to(near + 1), near + 1).otherwise(near)
    exponent = F.greatest(exact, F.lit(-1022))
    bits = (exponent + 1022).cast("long") * F.lit(1 << 52) + (size / two_to(exponent) * F.lit(float(1 << 52))).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(size == F.lit(float("inf")), F.lit(2047 << 52)).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


# Bits that a cell leaves open after each pass: no pass has more than 2^22 cells in one group.
_OPEN_BITS = (42, 21, 0)


def grouped_quantiles(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """As ``quantiles``, per group: columns of ``keys``, measure, probability, value. Null keys are a group. Groups
    without a value of a measure have no rows for it; infinite values count, nulls and NaN do not.

    Three passes over the table serve all groups at once, however many there are and whatever their values. The first
    cell of a value is the head of its bits, which needs no bounds of its group; each pass counts the values per cell
    before anything is sent, keeps the cell with the rank, and the next one goes on among its values. So a
    group with most of all rows sends as many rows as it has cells, and nothing passes through the driver.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    numbers = [
        F.struct(F.lit(m).alias("_measure"), F.when(~F.isnan(m), F.col(m).cast("double")).alias("_value")) for m in measures
    ]
    key_columns = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    rows = df.select(*key_columns, F.inline(F.array(*numbers))).filter(F.col("_value").isNotNull())
    rows = rows.withColumn("_order", _order(F.col("_value")))
    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("_probability"), F.lit(Decimal(repr(float(p)))).cast("decimal(18,17)").alias("_share"))
        for p in probabilities
    ])
    same = [*names, "_measure"]
    held = None
    for bits in _OPEN_BITS:
        cell = F.shiftright("_order", bits).alias("_cell")
        if held is None:
            counted = rows.groupBy(*same, cell).agg(F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_value"))
            total = F.sum("_rows").over(Window.partitionBy(*same))
            ranked = counted.withColumn("_total", total).select("*", F.inline(wanted))
            rank = F.greatest(F.lit(1), F.ceil(F.col("_share") * F.col("_total").cast("decimal(18,0)"))).cast("long")
            counted = ranked.withColumn("_rank", rank)
        else:
            within = held.select(*[F.col(c).alias(f"h{c}") for c in same], "_probability", "_rank", "_cell")
            match = F.shiftright("_order", before) == F.col("_cell")
            for c in same:
                match = match & F.col(c).eqNullSafe(F.col(f"h{c}"))
            open_ = rows.join(within, match).drop("_cell", *[f"h{c}" for c in same])
            counted = open_.groupBy(*same, "_probability", "_rank", cell).agg(
                F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_value")
            )
        upto = F.sum("_rows").over(Window.partitionBy(*same, "_probability").orderBy("_cell"))
        passed = counted.withColumn("_passed", upto - F.col("_rows"))
        first = (F.col("_passed") < F.col("_rank")) & (F.col("_rank") <= F.col("_passed") + F.col("_rows"))
        held = passed.filter(first).withColumn("_rank", F.col("_rank") - F.col("_passed"))
        held = stage(held.select(*same, "_probability", "_rank", "_cell", "_value"), "quantiles") if bits else held
        before = bits
    return held.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        F.col("_measure").alias("measure"),
        F.col("_probability").alias("probability"),
        F.col("_value").alias("value"),
    )
