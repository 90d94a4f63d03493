"""Latest rows, recent rows and neighbours in time, for all stations at once.

Every operator here keeps a bounded number of rows per station and discards the rest on the map
side, so a station with very many rows does not fill a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME


def _first_of(df: DataFrame, rank: Column) -> DataFrame:
    """The row of each station with the least ``rank``. A hash aggregation over the rank's columns finds it, so that no
    row but those that reach it is sorted; a station whose ranks are all null keeps one of its rows."""
    least = df.groupBy(F.col(STATION).alias("_station")).agg(F.min(rank).alias("_least"))
    first = F.col(STATION).eqNullSafe(F.col("_station")) & rank.eqNullSafe(F.col("_least"))
    few = df.join(least, first, "left_semi")
    return few.groupBy(STATION).agg(F.any_value(F.struct(*df.columns)).alias("_row")).select("_row.*")


def latest(df: DataFrame) -> DataFrame:
    """The newest row of each station."""
    return _first_of(df, -F.unix_micros(TIME))


def recent(df: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` newest rows of each station with their ``recency`` (1 is the newest). Spark drops
    the others before the shuffle for up to 1000 rows (``windowGroupLimitThreshold``)."""
    newest_first = Window.partitionBy(STATION).orderBy(F.col(TIME).desc())
    return df.withColumn("recency", F.row_number().over(newest_first)).filter(F.col("recency") <= rows)


def latest_with_change(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The newest row of each station with ``<measure>_delta`` against the row before; 0 when there
    is none."""
    newest_first = Window.partitionBy(STATION).orderBy(F.col(TIME).desc())
    change = {
        f"{m}_delta": F.col(m) - F.coalesce(F.lead(m).over(newest_first), F.col(m)) for m in measures
    }
    return recent(df, 2).withColumns(change).filter(F.col("recency") == 1).drop("recency")


def nearest(df: DataFrame, instant: Column) -> DataFrame:
    """The row of each station closest in time to ``instant``; the earlier one on a tie."""
    away = F.unix_micros(TIME) - F.unix_micros(instant)
    return _first_of(df, 2 * F.abs(away) + (away > 0).cast("long"))


def last_days(df: DataFrame, days: int) -> DataFrame:
    """Rows newer than ``days`` days before their station's newest row."""
    newest = df.groupBy(STATION).agg(F.max(TIME).alias("_newest"))
    return (
        df.join(newest, STATION)
        .filter(F.col(TIME) > F.col("_newest") - F.make_dt_interval(F.lit(days)))
        .drop("_newest")
    )


def station_list(df: DataFrame) -> DataFrame:
    return df.select(STATION, "location_name").dropDuplicates().orderBy("location_name", STATION)


def long_form(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per station, instant and measure."""
    return df.select(STATION, TIME, *measures).unpivot([STATION, TIME], list(measures), "measure", "value")
