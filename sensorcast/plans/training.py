"""Fitting, storing and applying forecast models with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.config import STATION, TIME, FeatureConfig, ForestConfig, SplitConfig, label_name
from sensorcast.functions.calendar import hours_later
from sensorcast.operators import chunks, metrics
from sensorcast.plans import forests
from sensorcast.plans.features import build_features, chronological_split, complete
from sensorcast.staging import path_exists, stage

Estimator = Callable[[str], object]
VECTOR = "features"
# Training rows from which forests are grown by ``forests``; with fewer, starting its passes takes longer than Spark ML's fit.
MANY_ROWS = 1_000_000


def forest(config: ForestConfig = ForestConfig()) -> Estimator:
    return lambda label: RandomForestRegressor(
        labelCol=label,
        featuresCol=VECTOR,
        seed=config.seed,
        numTrees=config.trees,
        maxDepth=config.depth,
        maxBins=config.bins,
        minInstancesPerNode=config.min_instances,
    )


def linear(reg: float = 0.0) -> Estimator:
    return lambda label: LinearRegression(labelCol=label, featuresCol=VECTOR, regParam=reg)


def boosted(iterations: int = 20, depth: int = 5, seed: int = 42) -> Estimator:
    return lambda label: GBTRegressor(labelCol=label, featuresCol=VECTOR, maxIter=iterations, maxDepth=depth, seed=seed)


def _together(job: Callable, items: Sequence, parallelism: int) -> list:
    """Run one Spark job per item, a few at a time; results in the order of the items."""
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(job, items, chunksize=1)


def persistence_model(config: FeatureConfig, column: str | None = None) -> PipelineModel:
    """A model that foretells the value of ``column``, the current one by default: the yardstick as something that can be
    stored, loaded and scored like any other."""
    assembler = VectorAssembler(inputCols=config.features, outputCol=VECTOR, handleInvalid="error")
    same = SQLTransformer(statement=f"SELECT *, `{column or config.target}` AS prediction FROM __THIS__")
    return PipelineModel(stages=[assembler, same])


def pipeline(features: Sequence[str], estimator) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")
    return Pipeline(stages=[assembler, estimator])


def training_table(readings: DataFrame, config: FeatureConfig, horizons: Sequence[int]) -> DataFrame:
    """Complete feature rows with all labels and their position in the series, staged once for any
    number of fits. Each fit then reads the features and its own label only."""
    featured = complete(build_features(readings, config, horizons, keep_chunks=True), config)
    keep = [STATION, TIME, *config.features, *[label_name(h) for h in horizons], chunks.CHUNK]
    rows = featured.select(*dict.fromkeys(keep))
    labels = [label_name(h) for h in horizons]
    return stage(chunks.with_series_rank(rows, config.chunking, labels).drop(chunks.CHUNK), "training")


def next_step_table(readings: DataFrame, config: FeatureConfig, split: SplitConfig) -> DataFrame:
    """Complete feature rows with the next-step label and the part of the split they belong to."""
    label = label_name(1)
    featured = complete(build_features(readings, config, [1], keep_chunks=True), config, [label])
    rows = featured.select(STATION, TIME, *config.features, label, chunks.CHUNK)
    return stage(chronological_split(rows, split, config.chunking), "next-step")


def _labelled(horizon: int) -> tuple[Column, Column]:
    """Position of a row among its station's rows that have the horizon's label, and their number."""
    label = label_name(horizon)
    return F.col("series_rank") - F.col(f"missing_{label}"), F.col(f"present_{label}")


def in_training(horizon: int, split: SplitConfig) -> Column:
    """Rows for fitting one horizon: the first share of those that have its label, whatever gaps there
    are; ``purge`` keeps back rows whose label lies beyond the cut."""
    rank, rows = _labelled(horizon)
    return F.col(label_name(horizon)).isNotNull() & (rank <= rows * F.lit(split.train) - F.lit(split.purge))


def in_test(horizon: int, split: SplitConfig) -> Column:
    rank, rows = _labelled(horizon)
    return F.col(label_name(horizon)).isNotNull() & (rank > rows * F.lit(split.train + split.validation))


def train_horizons(
    table: DataFrame,
    config: FeatureConfig,
    horizons: Sequence[int],
    estimator: Estimator = forest(),
    split: SplitConfig = SplitConfig(),
    parallelism: int = 4,
    many_rows: int = MANY_ROWS,
) -> dict[int, PipelineModel]:
    """One model per horizon; a horizon without training rows gets none. Fits run as concurrent Spark
    jobs, so the cluster is not idle in the small last stages of each. Forests over ``many_rows`` and more are
    grown by ``forests``, from rows that are put into bins once for all horizons."""
    counts = table.agg(*[F.count_if(in_training(h, split)).alias(f"h{h}") for h in horizons]).first()
    horizons = [h for h in horizons if counts[f"h{h}"]]
    most = max((counts[f"h{h}"] for h in horizons), default=0)
    if horizons and most >= many_rows and forests.can_fit(estimator(VECTOR)):
        return _train_forests(table, config, horizons, estimator, split, parallelism, most)

    def fit(horizon: int) -> tuple[int, PipelineModel]:
        label = label_name(horizon)
        rows = table.filter(in_training(horizon, split)).select(*config.features, label)
        return horizon, pipeline(config.features, estimator(label)).fit(rows)

    return dict(_together(fit, horizons, parallelism))


def _train_forests(
    table: DataFrame, config: FeatureConfig, horizons: Sequence[int], estimator: Estimator, split: SplitConfig, parallelism: int, count: int
) -> dict[int, PipelineModel]:
    kinds = {h: estimator(label_name(h)) for h in horizons}
    labels = {h: F.when(in_training(h, split), F.col(label_name(h))).alias(label_name(h)) for h in horizons}
    rows = table.filter(reduce(or_, [in_training(h, split) for h in horizons])).select(*config.features, *labels.values())
    any_kind = kinds[horizons[0]]
    names = [label_name(h) for h in horizons]
    blocks, bounds = forests.prepare(rows, config.features, names, any_kind.getMaxBins(), any_kind.getSeed(), count)

    def fit(horizon: int) -> tuple[int, PipelineModel]:
        grown = forests.fit(blocks, bounds, label_name(horizon), kinds[horizon], count)
        return horizon, PipelineModel(stages=[pipeline(config.features, kinds[horizon]).getStages()[0], grown])

    return dict(_together(fit, horizons, parallelism))


def one_hour_model(
    readings: DataFrame,
    config: FeatureConfig = FeatureConfig(),
    estimator: Estimator = forest(ForestConfig(min_instances=2)),
    split: SplitConfig = SplitConfig(),
) -> tuple[PipelineModel, DataFrame]:
    """Next-step model and its hold-out metrics, one row: mae, rmse, r2, mape, rows, test_rows,
    locations."""
    label = label_name(1)
    parts = next_step_table(readings, config, split)
    model = pipeline(config.features, estimator(label)).fit(parts.filter("part = 'train'"))
    scored = model.transform(parts.filter("part = 'test'"))
    quality = metrics.regression_metrics(scored, F.col(label), F.col("prediction"))
    counts = F.struct(F.count(F.lit(1)).alias("rows"), F.count_distinct(STATION).alias("locations"))
    size = parts.agg(counts.alias("size")).scalar()
    return model, quality.withColumnRenamed("rows", "test_rows").withColumns(
        {"rows": size["rows"], "locations": size["locations"]}
    )


def best_by_validation(
    readings: DataFrame,
    candidates: Mapping[str, Estimator],
    config: FeatureConfig = FeatureConfig(),
    split: SplitConfig = SplitConfig(train=0.6, validation=0.2),
) -> tuple[str, PipelineModel, DataFrame]:
    """Fit several kinds of model for the next step, keep the one with the lowest validation RMSE.
    Also returns every candidate's validation and test metrics."""
    label = label_name(1)
    parts = next_step_table(readings, config, split)
    train, later = parts.filter("part = 'train'"), parts.filter("part IN ('validation', 'test')")
    models = {}
    for name, estimator in candidates.items():
        models[name] = pipeline(config.features, estimator(label)).fit(train)
    scored = later
    for name, model in models.items():
        scored = _apply(scored, model, f"p_{name}", keep_vector=True)
    pairs = [F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("prediction")) for n in models]
    long = scored.select("part", label, F.inline(F.array(*pairs)))
    table = metrics.regression_metrics(long, F.col(label), F.col("prediction"), ["model", "part"])
    # A handful of rows: candidates x parts.
    table = stage(table, "candidates-metrics")
    best = table.filter("part = 'validation'").orderBy("rmse", "model").first()["model"]
    return best, models[best], table


def per_station_models(
    readings: DataFrame,
    stations: Sequence[str],
    config: FeatureConfig = FeatureConfig(),
    estimator: Estimator = forest(ForestConfig(min_instances=2)),
    split: SplitConfig = SplitConfig(),
    parallelism: int = 4,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """A model of its own for each listed station, and hold-out metrics by station."""
    label = label_name(1)
    parts = next_step_table(readings.filter(F.col(STATION).isin(list(stations))), config, split)

    def fit(station: str) -> tuple[str, PipelineModel]:
        own = parts.filter((F.col(STATION) == station) & (F.col("part") == "train"))
        return station, pipeline(config.features, estimator(label)).fit(own)

    models = dict(_together(fit, stations, parallelism))
    tests = parts.filter("part = 'test'")
    scored = None
    for station in stations:
        own = models[station].transform(tests.filter(F.col(STATION) == station))
        own = own.select(STATION, label, "prediction")
        scored = own if scored is None else scored.unionByName(own)
    return models, metrics.regression_metrics(scored, F.col(label), F.col("prediction"), [STATION])


# Storing


def save_models(spark: SparkSession, models: Mapping[int, PipelineModel], root: str, parallelism: int = 4) -> DataFrame:
    """Write each model to ``<root>/h<n>`` and a manifest beside them, with paths below ``root``; returns the
    manifest. It lists these models only: keep several sets apart, or in a ``registry``."""

    def save(horizon: int) -> tuple[int, str, list[str]]:
        path = f"h{horizon}"
        models[horizon].write().overwrite().save(f"{root}/{path}")
        return horizon, path, models[horizon].stages[0].getInputCols()

    rows = _together(save, sorted(models), parallelism)
    manifest = spark.createDataFrame(rows, "horizon_hours int, path string, features array<string>")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
    return manifest


def load_models(
    spark: SparkSession, root: str, horizons: Sequence[int] | None = None, parallelism: int = 4
) -> dict[int, PipelineModel]:
    """Models listed in the manifest below ``root``, or those of the given horizons."""
    manifest = spark.read.parquet(f"{root}/manifest")
    if horizons is not None:
        manifest = manifest.filter(F.col("horizon_hours").isin(list(horizons)))
    # One row per horizon, as many as save_models was given.
    rows = manifest.orderBy("horizon_hours").collect()
    models = _together(lambda row: PipelineModel.load(f"{root}/{row['path']}"), rows, parallelism)
    return {row["horizon_hours"]: model for row, model in zip(rows, models)}


def load_or_train(spark: SparkSession, root: str, train: Callable[[], Mapping[int, PipelineModel]]) -> dict[int, PipelineModel]:
    """Stored models, or new ones from ``train``, which are stored first."""
    if path_exists(spark, f"{root}/manifest"):
        return load_models(spark, root)
    models = dict(train())
    save_models(spark, models, root)
    return models


# Applying


def _apply(df: DataFrame, model: PipelineModel, column: str, keep_vector: bool = False) -> DataFrame:
    """Add one model's prediction as ``column``, assembling the vector only if it is not there yet."""
    assembler, fitted = model.stages[0], model.stages[-1]
    out = df if VECTOR in df.columns else assembler.transform(df)
    if fitted.hasParam("predictionCol"):
        out = fitted.copy({fitted.getParam("predictionCol"): column}).transform(out)
    else:
        out = fitted.transform(out).withColumnRenamed("prediction", column)
    return out if keep_vector else out.drop(VECTOR)


def _spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly by station and time to as many tasks as a shuffle has. The number is given, so that
    adaptive execution does not join them again: it goes by bytes, and forests take far longer over a byte than reads."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), STATION, TIME)


def score_horizons(featured: DataFrame, models: Mapping[int, PipelineModel], spread: bool = False) -> DataFrame:
    """Complete feature rows with a column ``predicted_h<n>`` per model. One vector, one pass: the
    models run side by side in a single projection.

    Rows that come from windows lie in a task per long station or chunk. ``spread`` deals them out first, for large
    tables and models that take time; forests are then applied to blocks of rows."""
    inputs = {tuple(m.stages[0].getInputCols()) for m in models.values()}
    if len(inputs) > 1:
        raise ValueError("models to be scored together must share their feature columns")
    out = _spread(featured) if spread else featured
    if spread and models and all(map(forests.can_score, models.values())):
        fitted = {f"predicted_h{h}": m.stages[-1] for h, m in sorted(models.items())}
        return forests.predict(out, next(iter(inputs)), fitted)
    for horizon, model in sorted(models.items()):
        out = _apply(out, model, f"predicted_h{horizon}", keep_vector=True)
    return out.drop(VECTOR)


def forecasts_long(scored: DataFrame, horizons: Sequence[int], target: str = "pm25", also: Sequence[str] = ()) -> DataFrame:
    """The forecast table: one row per reading and horizon, with the reading's columns ``also`` behind."""
    pairs = [
        F.struct(F.lit(h).alias("horizon_hours"), F.col(f"predicted_h{h}").alias(f"predicted_{target}"))
        for h in sorted(horizons)
    ]
    keep = dict.fromkeys((STATION, "location_name", TIME, target, "aqi"))
    long = scored.select(*keep, *also, F.inline(F.array(*pairs)))
    return long.withColumn("forecast_for", hours_later(F.col(TIME), F.col("horizon_hours"))).select(
        *keep, f"predicted_{target}", "horizon_hours", "forecast_for", *also
    )


def persistence_forecasts(readings: DataFrame, horizons: Sequence[int], target: str = "pm25") -> DataFrame:
    """The yardstick: every horizon is forecast to equal the current value."""
    same = {f"predicted_h{h}": F.col(target) for h in horizons}
    return forecasts_long(readings.withColumns(same), horizons, target)


def holdout_metrics(
    table: DataFrame,
    models: Mapping[int, PipelineModel],
    split: SplitConfig = SplitConfig(),
    target: str = "pm25",
) -> DataFrame:
    """MAE, RMSE, R², MAPE and rating by horizon on the test rows, next to the persistence forecast.
    All horizons are scored in one pass over the table. The test rows are the ends of the stations, which lie in few
    of the table's files, and so are dealt out first."""
    tested = reduce(or_, [in_test(h, split) for h in models])
    scored = score_horizons(table.filter(tested), models, spread=True)
    rows = [
        F.struct(
            F.lit(h).alias("horizon_hours"),
            F.when(in_test(h, split), F.col(label_name(h))).alias("actual"),
            F.col(f"predicted_h{h}").alias("predicted"),
        )
        for h in sorted(models)
    ]
    long = scored.select(target, F.inline(F.array(*rows))).filter(F.col("actual").isNotNull())
    model = metrics.error_aggregates(F.col("actual"), F.col("predicted"))
    same = metrics.error_aggregates(F.col("actual"), F.col(target))
    table = long.groupBy("horizon_hours").agg(
        F.count(F.lit(1)).alias("test_rows"),
        *[e.alias(name) for name, e in model.items()],
        same["rmse"].alias("persistence_rmse"),
    )
    return metrics.with_rating(table)
