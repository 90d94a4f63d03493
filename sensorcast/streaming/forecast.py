"""Forecasting new readings as they land, in two streaming jobs.

The first turns each micro-batch of readings into feature rows, for which it needs the recent
history of the stations concerned. The second scores feature rows with every model. Only the first
has to build a new plan per micro-batch; the second is planned once, so the models are shipped to
the executors once and not with every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorcast.config import STATION, TIME, FeatureConfig
from sensorcast.operators.clean import keep_last
from sensorcast.plans.features import build_features, complete
from sensorcast.plans.training import forecasts_long, score_horizons
from sensorcast.schema import DATE, FORECAST_DATE, LANDED_AT, READING_SCHEMA, REVISION, SCORED_AT, SOURCE_OFFSET
from sensorcast.sources.published import PLACE, is_published, publish_batch, read_published
from sensorcast.staging import ensure_table

History = Callable[[SparkSession], DataFrame]


def bounded_history(history: DataFrame, keys: DataFrame, lookback_hours: int) -> DataFrame:
    """The part of the history that features of ``keys`` can depend on.

    Time is cut into slots as long as the lookback, so each key needs its own slot and the one
    before: an equality join that spreads by (station, slot) and serves late readings as well as
    new ones. The overall time range, a pair of scalars, prunes the scan beforehand.
    """
    span = lookback_hours * 3600
    lookback = F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    # As numbers: Python datetimes would pass through the driver's own time zone.
    at = F.unix_micros(TIME)
    limits = keys.agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    first = F.timestamp_micros(F.lit(limits["first"])) - lookback
    last = F.timestamp_micros(F.lit(limits["last"]))
    near = history.filter(F.col(TIME).between(first, last))
    if DATE in history.columns:
        near = near.filter(F.col(DATE).between(F.to_date(first), F.to_date(last)))
    slot = F.expr(f"unix_seconds({TIME}) div {span}")
    needed = keys.select(STATION, F.explode(F.array(slot, slot - 1)).alias("_slot")).dropDuplicates()
    return near.withColumn("_slot", slot).join(needed, [STATION, "_slot"], "left_semi").drop("_slot")


def features_of(history: DataFrame, keys: DataFrame, config: FeatureConfig, lookback_hours: int | None) -> DataFrame:
    """Complete feature rows of the readings named by ``keys`` (station, instant)."""
    if lookback_hours is None:
        near = history.join(keys.select(STATION).distinct(), STATION, "left_semi")
    else:
        near = bounded_history(history, keys, lookback_hours)
    # The reading that landed last; where that is not known, the choice is at least always the same.
    unique = keep_last(near, [*[c for c in (LANDED_AT, SOURCE_OFFSET) if c in near.columns], *config.measures])
    featured = complete(build_features(unique, config), config)
    return featured.join(keys, [STATION, TIME], "left_semi").select(feature_schema(config).names)


def feature_schema(config: FeatureConfig) -> T.StructType:
    keys = [f for f in READING_SCHEMA if f.name in (STATION, "location_name", TIME)]
    return T.StructType(keys + [T.StructField(name, T.DoubleType()) for name in config.features])


def feature_batch(
    batch: DataFrame, batch_id: int, history: History, path: str, run_id: str, config: FeatureConfig, lookback_hours: int | None
) -> None:
    """Publish the feature rows of one micro-batch. A replayed batch that is published is left alone;
    one that was only half written is written anew."""
    spark = batch.sparkSession
    if is_published(spark, path, run_id, batch_id):
        return
    keys = batch.select(STATION, TIME).dropna().dropDuplicates().persist()
    try:
        if not keys.isEmpty():
            publish_batch(features_of(history(spark), keys, config, lookback_hours), path, run_id, batch_id)
    finally:
        keys.unpersist()


def feature_stream(
    readings: DataFrame,
    history: History,
    path: str,
    checkpoint: str,
    run_id: str,
    config: FeatureConfig = FeatureConfig(step="hours"),
    lookback_hours: int | None = 24,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the features of every landed reading to ``path``.

    ``run_id`` belongs to the checkpoint: batch numbers restart with a new one. Features counted in
    hours need a lookback of their longest reach. Features counted in rows take no lookback: with
    gaps, no number of hours is sure to hold the rows before a key. They read the whole history of
    the batch's stations.
    """
    if config.step == "rows" and lookback_hours is not None:
        raise ValueError("features counted in rows need lookback_hours=None")
    needed = config.reach + (1 if config.tolerance_minutes else 0)
    if config.step == "hours" and lookback_hours is not None and lookback_hours < needed:
        raise ValueError(f"lookback of {lookback_hours} h is shorter than the features' {needed} h")

    def handle(batch: DataFrame, batch_id: int) -> None:
        feature_batch(batch, batch_id, history, path, run_id, config, lookback_hours)

    writer = readings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_features(spark: SparkSession, path: str, config: FeatureConfig = FeatureConfig(step="hours")) -> DataFrame:
    """The rows that ``feature_stream`` has published."""
    return read_published(spark, path, feature_schema(config))


def numbered_rows(spark: SparkSession, features_path: str, config: FeatureConfig) -> DataFrame:
    """A stream of feature rows, from either feature stream, each with the number of its version. It
    does not wait for a batch to be published: rows of a broken attempt come once more with the next one, and
    of forecasts the last counts."""
    schema = feature_schema(config)
    stored = T.StructType([*schema.fields, T.StructField(REVISION, T.LongType()), *PLACE.fields])
    ensure_table(spark, features_path, stored, PLACE.names)
    rows = spark.readStream.schema(stored).parquet(features_path)
    return rows.select(*schema.names, F.coalesce(REVISION, "batch_id").alias(REVISION))


def score_stream(
    spark: SparkSession,
    features_path: str,
    models: Mapping[int, PipelineModel],
    path: str,
    checkpoint: str,
    config: FeatureConfig = FeatureConfig(step="hours"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Forecast every complete feature row for every horizon in ``models``; pass one model for the one-hour
    job. Each row lands in ``path`` once, in the folder of its reading's date, with the time of scoring and the
    version of the feature row."""
    rows = numbered_rows(spark, features_path, config)
    forecasts = forecasts_long(score_horizons(complete(rows, config), models), list(models), config.target, [REVISION])
    stored = forecasts.withColumns({SCORED_AT: F.current_timestamp(), FORECAST_DATE: F.to_date(TIME)})
    writer = stored.writeStream.format("parquet").outputMode("append").partitionBy(FORECAST_DATE)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
