"""Versions of a set of models, of which one is current.

Each version is a folder that never changes, with a manifest whose paths are relative, so a registry can be copied
or moved. A row in a small table makes a version current; the last such row counts, so going back is one row more.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorcast.config import TIME, FeatureConfig
from sensorcast.plans.features import complete
from sensorcast.plans.training import forecasts_long, load_models, save_models, score_horizons
from sensorcast.schema import FORECAST_DATE, MODEL_VERSION, REVISION, SCORED_AT, VERSIONED_FORECAST_SCHEMA
from sensorcast.sources.published import is_published, publish_batch, read_published
from sensorcast.staging import path_exists
from sensorcast.streaming.forecast import numbered_rows

_POINTERS = "version string, current_from timestamp, number long"


def version_path(root: str, version: str) -> str:
    return f"{root}/versions/{version}"


def _pointers(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/current"
    return spark.read.schema(_POINTERS).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], _POINTERS)


def make_current(spark: SparkSession, root: str, version: str) -> None:
    """Let streams and jobs use ``version`` from now on."""
    if not path_exists(spark, f"{version_path(root, version)}/manifest"):
        raise ValueError(f"there is no version {version}")
    # A row per change; the number orders those of one instant.
    number = (_pointers(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    row = spark.createDataFrame([(version, number)], "version string, number long")
    row.select("version", F.current_timestamp().alias("current_from"), "number").coalesce(1).write.mode("append").parquet(f"{root}/current")


def add_version(spark: SparkSession, models: Mapping[int, PipelineModel], root: str, version: str | None = None) -> str:
    """Store models as a new version and make it current; returns its name. A name can be used once."""
    version = version or f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    if path_exists(spark, f"{version_path(root, version)}/manifest"):
        raise ValueError(f"version {version} is there already")
    save_models(spark, models, version_path(root, version))
    make_current(spark, root, version)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    last = _pointers(spark, root).orderBy(F.col("number").desc(), F.col("current_from").desc()).first()
    return last and last["version"]


def load_current(spark: SparkSession, root: str) -> tuple[str, dict[int, PipelineModel]]:
    version = current_version(spark, root)
    if version is None:
        raise ValueError(f"no version of models below {root} is current")
    return version, load_models(spark, version_path(root, version))


def reloading_score_stream(
    spark: SparkSession,
    features_path: str,
    root: str,
    path: str,
    checkpoint: str,
    run_id: str,
    config: FeatureConfig = FeatureConfig(step="hours"),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Forecast every complete feature row with the models that are current when its micro-batch starts, and publish
    the forecasts with their version. Models are loaded when the version changes, not with each batch.

    Planning each micro-batch anew costs more than ``score_stream``, which keeps one set of models; use that where
    a restart per version will do.
    """
    held: dict[str, dict[int, PipelineModel]] = {}

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if is_published(session, path, run_id, batch_id):
            return
        version = current_version(session, root)
        if version not in held:
            held.clear()
            held.update([load_current(session, root)])
            (version,) = held
        models = held[version]
        scored = forecasts_long(score_horizons(complete(batch, config), models), list(models), config.target, [REVISION])
        stored = scored.withColumns(
            {SCORED_AT: F.current_timestamp(), MODEL_VERSION: F.lit(version), FORECAST_DATE: F.to_date(TIME)}
        )
        publish_batch(stored, path, run_id, batch_id)

    writer = numbered_rows(spark, features_path, config).writeStream.foreachBatch(handle)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_versioned_forecasts(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path, VERSIONED_FORECAST_SCHEMA).drop("run_id", "batch_id")
