"""The one feature builder used by training, evaluation and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME, FeatureConfig, SplitConfig, label_name
from sensorcast.functions import calendar
from sensorcast.functions.stations import station_code
from sensorcast.operators import chunks

_HOUR = 3_600_000_000  # microseconds


def with_shifts(
    readings: DataFrame, config: FeatureConfig, horizons: Sequence[int] = (), measures: Sequence[str] | None = None
) -> DataFrame:
    """Add lags, rolling means of the steps before the row, and one label per horizon.

    All of them share one partitioning and one sort, whatever their number. ``measures`` defaults to
    the target; labels are made for the target only. Rows without station or time have no place in a
    series and are left out. Leaves the chunk column in place.
    """
    readings = readings.filter(F.col(STATION).isNotNull() & F.col(TIME).isNotNull())
    measures = list(measures or [config.target])
    ahead = max(horizons, default=0)
    shifts = {}
    if config.step == "rows":
        placed = chunks.with_row_halo(readings, measures, config.reach, ahead, config.chunking)
        window = chunks.chunk_window()
        for m in measures:
            shifts |= {f"{m}_lag{k}": F.lag(m, k).over(window) for k in config.lags}
            shifts |= {f"{m}_mean{k}": F.avg(m).over(window.rowsBetween(-k, -1)) for k in config.means}
        shifts |= {label_name(h): F.lead(config.target, h).over(window) for h in horizons}
    else:
        off = round(config.tolerance_minutes * 60_000_000)
        placed = chunks.with_time_halo(readings, config.reach * _HOUR + off, ahead * _HOUR + (off if ahead else 0), config.chunking)
        # A column, so that all windows share one sort.
        placed, instant = placed.withColumn("_at", F.unix_micros(TIME)), F.col("_at")
        window = Window.partitionBy(STATION, chunks.CHUNK).orderBy(instant)
        if off:
            # Each reading with the one that follows it, so that one look finds both neighbours of an instant.
            following = {f"_next_{m}": F.lead(m).over(window) for m in measures}
            for k in config.means:
                # Time in slots as long as the range of the mean, and of each reading what its slot still holds from it on.
                width = F.lit(k * _HOUR)
                placed = placed.withColumn(f"_slot{k}", ((instant - F.pmod(instant, width)) / width).cast("long"))
                to_end = Window.partitionBy(STATION, chunks.CHUNK, f"_slot{k}").orderBy(instant.desc())
                to_end = to_end.rangeBetween(Window.unboundedPreceding, Window.currentRow)
                parts = [F.struct(F.sum(m).over(to_end).alias("sum"), F.count(m).over(to_end).alias("rows")).alias(m) for m in measures]
                placed = placed.withColumn(f"_rest{k}", F.struct(F.col(f"_slot{k}").alias("slot"), *parts))
                following[f"_next_rest{k}"] = F.lead(f"_rest{k}").over(window)
            placed = placed.withColumns({"_next": F.lead(instant).over(window)} | following)
        so_far = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)

        def at(m, hours):
            middle = hours * _HOUR
            if not off:
                # The frame is a single instant; keys are unique, so any aggregate picks its value.
                return F.max(m).over(window.rangeBetween(middle, middle))
            # Of the last reading up to the instant and the first one from it the nearer. The frame only grows: one of the
            # tolerance alone would be read anew for every row. Of readings at one instant that with the latest next is last.
            seen = {"at": instant, "ends": F.col("_next").isNull(), "next": F.col("_next"), "value": F.col(m)}
            row = F.struct(*[c.alias(n) for n, c in seen.items()], F.col(f"_next_{m}").alias("next_value"))
            before = F.max(row).over(window.rangeBetween(Window.unboundedPreceding, middle))
            # Where there is none before, all are behind, and the oldest comes first.
            oldest = F.first(row).over(so_far)
            early = instant + middle - before["at"]
            late = F.when(before.isNull(), oldest["at"]).otherwise(before["next"]) - instant - middle
            nearer = late.isNull() | (early <= late)
            behind = F.when(before.isNull(), oldest["value"]).otherwise(before["next_value"])
            return F.when((early <= off) & nearer, before["value"]).when(late <= off, behind)

        def mean(m, k):
            if not off:
                return F.avg(m).over(window.rangeBetween(-k * _HOUR, -1))
            # The end of one slot and the beginning of the next: a frame of the range would be added up anew for every row, and
            # readings at any minute may be many.
            seen = F.struct(instant.alias("at"), F.col("_next").isNull().alias("ends"), F.col("_next").alias("next"), F.col(f"_next_rest{k}").alias("rest"))
            before = F.max(seen).over(window.rangeBetween(Window.unboundedPreceding, -k * _HOUR - 1))
            rest = F.when(before.isNull(), F.first(f"_rest{k}").over(so_far)).otherwise(before["rest"])
            rest = F.when(rest["slot"] == F.col(f"_slot{k}") - 1, rest[m])
            own = Window.partitionBy(STATION, chunks.CHUNK, f"_slot{k}").orderBy(instant).rangeBetween(Window.unboundedPreceding, -1)
            total = F.coalesce(rest["sum"], F.lit(0.0)) + F.coalesce(F.sum(m).over(own), F.lit(0.0))
            rows = F.coalesce(rest["rows"], F.lit(0)) + F.count(m).over(own)
            return F.when(rows > 0, total / rows)

        for m in measures:
            shifts |= {f"{m}_lag{k}": at(m, -k) for k in config.lags}
            shifts |= {f"{m}_mean{k}": mean(m, k) for k in config.means}
        shifts |= {label_name(h): at(config.target, h) for h in horizons}
    made = [f"_next_{m}" for m in measures] + [f"{n}{k}" for n in ("_slot", "_rest", "_next_rest") for k in config.means]
    return chunks.drop_halo(placed.withColumns(shifts)).drop("_at", "_next", *made)


def build_features(
    readings: DataFrame, config: FeatureConfig, horizons: Sequence[int] = (), keep_chunks: bool = False
) -> DataFrame:
    """Readings with every feature column and a label column per horizon. Rows whose history or
    future is missing keep nulls; see ``complete``."""
    shifted = with_shifts(readings, config, horizons)
    featured = shifted.withColumns(
        {
            "hour": calendar.hour_of_day(F.col(TIME)),
            "day_of_week": calendar.day_of_week_fraction(F.col(TIME)),
            "location_code": station_code(F.col(STATION), config.station_codes, config.unknown_code),
        }
    )
    return featured if keep_chunks else featured.drop(chunks.CHUNK)


def complete(featured: DataFrame, config: FeatureConfig, labels: Sequence[str] = ()) -> DataFrame:
    """Rows usable by a model: no null or NaN among the features and the given labels."""
    return featured.dropna(subset=config.features + list(labels))


def labels_long(labelled: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per reading and horizon with its ``target``; the wide row is read once."""
    pairs = [
        F.struct(F.lit(h).alias("horizon_hours"), F.col(label_name(h)).alias("target")) for h in horizons
    ]
    return labelled.select(*keep, F.inline(F.array(*pairs)))


def chronological_split(df: DataFrame, split: SplitConfig, chunking, keep_chunks: bool = False) -> DataFrame:
    """Add ``part``: train, validation or test by position within the station; null for purged rows."""
    ranked = chunks.with_series_rank(df, chunking)
    cut = F.col("series_rows") * F.lit(split.train)
    end = F.col("series_rows") * F.lit(split.train + split.validation)
    part = (
        F.when(F.col("series_rank") <= cut - F.lit(split.purge), F.lit("train"))
        .when(F.col("series_rank") <= cut, F.lit(None).cast("string"))
        .when(F.col("series_rank") <= end - F.lit(split.purge if split.validation else 0), F.lit("validation"))
        .when(F.col("series_rank") <= end, F.lit(None).cast("string"))
        .otherwise(F.lit("test"))
    )
    out = ranked.withColumn("part", part)
    return out if keep_chunks else out.drop(chunks.CHUNK)
