import math
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.config import FeatureConfig, ForestConfig, SplitConfig, label_name
from sensorcast.operators import metrics
from sensorcast.plans import training
from sensorcast.plans.features import build_features, complete
from sensorcast.staging import scratch_path

CONFIG = FeatureConfig()
SMALL = training.forest(ForestConfig(trees=3, depth=3))


@pytest.fixture
def source(make_readings):
    wave = lambda shift: [(h, 50 + 30 * math.sin((h + shift) / 4) + h % 3) for h in range(120)]
    return make_readings({"hanoi": wave(0), "hcm": wave(2), "danang": wave(5)})


@pytest.fixture
def table(source):
    return training.training_table(source, CONFIG, [1, 6])


def test_forest_settings():
    estimator = training.forest(ForestConfig(min_instances=2))("y")
    assert (estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMaxBins(), estimator.getSeed(), estimator.getMinInstancesPerNode()) == (20, 10, 32, 42, 2)


def test_training_rows(table):
    # 117 of 120 rows have features; the 6-hour label is missing for the last 6.
    assert table.filter(training.in_training(6, SplitConfig())).count() == 3 * int(111 * 0.8)
    assert table.filter(training.in_test(6, SplitConfig())).count() == 3 * (111 - int(111 * 0.8))
    purged = table.filter(training.in_training(6, SplitConfig(purge=6)))
    latest_label = purged.select(F.max(F.col("series_rank") + 6)).first()[0]
    earliest_test = table.filter(training.in_test(6, SplitConfig())).select(F.min("series_rank")).first()[0]
    assert latest_label < earliest_test


def test_table_does_not_depend_on_chunks(source, table):
    split = training.training_table(source, replace(CONFIG, chunking=replace(CONFIG.chunking, rows_per_chunk=25)), [1, 6])
    assert rows_of(split) == rows_of(table)


def test_models_survive_storage(spark, source, table):
    models = training.train_horizons(table, CONFIG, [1, 6], SMALL)
    root = scratch_path(spark, "models")
    manifest = training.save_models(spark, models, root)
    assert rows_of(manifest.select("horizon_hours")) == [(1,), (6,)]
    loaded = training.load_models(spark, root)
    rows = complete(build_features(source, CONFIG), CONFIG)
    before = training.forecasts_long(training.score_horizons(rows, models), [1, 6])
    after = training.forecasts_long(training.score_horizons(rows, loaded), [1, 6])
    assert rows_of(before) == rows_of(after)
    assert list(training.load_models(spark, root, [6])) == [6]


def test_load_or_train_trains_once(spark, table):
    root, calls = scratch_path(spark, "models"), []

    def train():
        calls.append(1)
        return training.train_horizons(table, CONFIG, [1], SMALL)

    training.load_or_train(spark, root, train)
    assert set(training.load_or_train(spark, root, train)) == {1}
    assert len(calls) == 1


def test_scoring_together_equals_scoring_apart(source, table):
    models = training.train_horizons(table, CONFIG, [1, 6], SMALL)
    rows = complete(build_features(source, CONFIG), CONFIG)
    wide = training.score_horizons(rows, models)
    for h, model in models.items():
        alone = model.transform(rows).select("location_id", "timestamp", F.round("prediction", 9))
        assert rows_of(alone) == rows_of(wide.select("location_id", "timestamp", F.round(f"predicted_h{h}", 9)))


def test_forecast_columns_and_keys(source, table):
    models = training.train_horizons(table, CONFIG, [1, 6], SMALL)
    rows = complete(build_features(source, CONFIG), CONFIG)
    forecasts = training.forecasts_long(training.score_horizons(rows, models), [1, 6])
    assert forecasts.columns == [
        "location_id", "location_name", "timestamp", "pm25", "aqi", "predicted_pm25", "horizon_hours", "forecast_for",
    ]
    assert forecasts.select("location_id", "timestamp", "horizon_hours").distinct().count() == forecasts.count() == 2 * 351
    assert forecasts.filter("forecast_for <> timestamp + make_interval(0,0,0,0,horizon_hours)").isEmpty()


def test_holdout_equals_metrics_per_model(table):
    models = training.train_horizons(table, CONFIG, [1, 6], SMALL)
    together = {r.horizon_hours: r for r in training.holdout_metrics(table, models).collect()}
    for h, model in models.items():
        test = model.transform(table.filter(training.in_test(h, SplitConfig())))
        alone = metrics.regression_metrics(test, F.col(label_name(h)), F.col("prediction")).first()
        assert together[h].test_rows == alone.rows
        assert together[h].rmse == pytest.approx(alone.rmse)
        assert together[h].r2 == pytest.approx(alone.r2)


def test_one_hour_model(source):
    model, quality = training.one_hour_model(source, CONFIG, SMALL)
    row = quality.first()
    assert (row.rows, row.test_rows, row.locations) == (348, 72, 3)
    assert row.rmse < 30


def test_linear_model_learns_a_line(make_readings):
    df = make_readings({"a": [(h, float(h)) for h in range(60)]})
    _, quality = training.one_hour_model(df, CONFIG, training.linear())
    assert quality.first().rmse == pytest.approx(0, abs=1e-3)


def test_best_candidate(make_readings):
    df = make_readings({"a": [(h, float(h)) for h in range(80)]})
    name, _, table = training.best_by_validation(df, {"forest": SMALL, "linear": training.linear()}, CONFIG)
    assert name == "linear"
    assert table.count() == 4


def test_boosted_and_per_station_models(source):
    models, quality = training.per_station_models(source, ["hanoi", "hcm"], CONFIG, training.boosted(2, 2))
    assert set(models) == {"hanoi", "hcm"}
    assert rows_of(quality.select("location_id", "rows")) == [("hanoi", 24), ("hcm", 24)]


def test_spread_scoring(spark, source, table):
    """A station whose rows lie in one task is scored by many, with the same results."""
    models = training.train_horizons(table, CONFIG, [1, 6], SMALL)
    rows = complete(build_features(source, CONFIG), CONFIG)
    wide = training.score_horizons(rows, models, spread=True)
    assert rows_of(wide) == rows_of(training.score_horizons(rows, models))
    one = training.score_horizons(rows.filter("location_id = 'hcm'"), models, spread=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() == tasks > 1


@pytest.fixture
def long_series(make_readings):
    wave = lambda shift: [(h, 50 + 30 * math.sin((h + shift) / 4) + (h + shift) * 7919 % 1009 / 50) for h in range(900)]
    return make_readings({"hanoi": wave(0), "hcm": wave(2), "danang": wave(5)})


def test_one_tree_of_many_rows_is_spark_mls(long_series):
    """Without draws there is one tree only: all rows, all features, at each node the best split."""
    table = training.training_table(long_series, CONFIG, [1, 6])
    for settings in (ForestConfig(trees=1, depth=6), ForestConfig(trees=1, depth=4, min_instances=30, bins=8)):
        for h in (1, 6):
            # Horizons trained together share the bounds of their bins.
            whole = lambda label: training.forest(settings)(label).setBootstrap(False)
            spark_ml = training.train_horizons(table, CONFIG, [h], whole)
            own = training.train_horizons(table, CONFIG, [h], whole, many_rows=0)
            (ours,), (theirs,) = own[h].stages[-1].trees, spark_ml[h].stages[-1].trees
            assert ours.depth == theirs.depth
            # Two features may part the training rows alike and others not.
            rows = table.filter(training.in_training(h, SplitConfig()))
            wide = training.score_horizons(rows, {1: own[h], 2: spark_ml[h]})
            assert wide.filter("abs(predicted_h1 - predicted_h2) > 1e-9").isEmpty()


def test_forests_of_many_rows(spark, long_series):
    """As good as Spark ML's, of all rows, the same each time, and its own class for storage."""
    table, config = training.training_table(long_series, CONFIG, [1, 6]), ForestConfig(trees=12, depth=7)
    spark_ml = training.train_horizons(table, CONFIG, [1, 6], training.forest(config))
    own = training.train_horizons(table, CONFIG, [1, 6], training.forest(config), many_rows=0)
    again = training.train_horizons(table, CONFIG, [1, 6], training.forest(config), many_rows=0)
    errors = [{r.horizon_hours: r.rmse for r in training.holdout_metrics(table, m).collect()} for m in (spark_ml, own)]
    for h, theirs in errors[0].items():
        assert errors[1][h] < 1.2 * theirs
    root = scratch_path(spark, "models")
    training.save_models(spark, own, root)
    rows = complete(build_features(long_series, CONFIG), CONFIG)
    found = [training.score_horizons(rows, m) for m in (own, training.load_models(spark, root))]
    assert rows_of(found[0]) == rows_of(found[1])
    six = [training.score_horizons(rows, {6: m[6]}).select("location_id", "timestamp", F.round("predicted_h6", 6)) for m in (own, again)]
    assert rows_of(six[0]) == rows_of(six[1])
    for h, model in own.items():
        forest, rows_used = model.stages[-1], table.filter(training.in_training(h, SplitConfig())).count()
        assert len(forest.trees) == 12 and max(t.depth for t in forest.trees) == 7
        drawn = [t._call_java("rootNode").impurityStats().stats()[0] for t in forest.trees]
        assert len(set(drawn)) > 1 and all(0.9 * rows_used < n < 1.1 * rows_used for n in drawn)


def test_forests_refuse_values_that_are_no_numbers(long_series):
    table = training.training_table(long_series, CONFIG, [1]).withColumn("target_h1", F.lit(float("nan")))
    with pytest.raises(Exception, match="NaN"):
        training.train_horizons(table, CONFIG, [1], SMALL, many_rows=0)


def test_forests_applied_to_blocks(source, table):
    """Scores of dealt rows are Spark ML's to the last bit."""
    models = training.train_horizons(table, CONFIG, [1, 6], training.forest(ForestConfig(trees=7, depth=6)))
    rows = complete(build_features(source, CONFIG), CONFIG)
    assert rows_of(training.score_horizons(rows, models)) == rows_of(training.score_horizons(rows, models, spread=True))
    both = training.score_horizons(rows, models, spread=True)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in both
