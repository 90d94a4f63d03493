import json
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.config import Chunking, FeatureConfig, ForestConfig
from sensorcast.functions.bands import AQI_BANDS
from sensorcast.operators.clean import keep_last
from sensorcast.plans import reports, training
from sensorcast.plans.features import build_features, complete
from sensorcast.schema import FORECAST_SCHEMA, READING_SCHEMA
from sensorcast.sources import readers, streams, writers
from sensorcast.streaming import forecast
from sensorcast.streaming.ingest import ingest_readings

ONCE = {"availableNow": True}
HOURS = FeatureConfig(step="hours")


def finish(*queries):
    for q in queries:
        q.awaitTermination()


def put(df, folder):
    writers.to_messages(df).select("value").write.mode("append").text(str(folder))


def ingest(spark, tmp_path, **options):
    source = streams.message_stream(spark, "json", str(tmp_path / "in"))
    out, state = (str(tmp_path / n) for n in ("out", "state"))
    finish(ingest_readings(source, out, state, trigger=ONCE, **options))
    return readers.read_landed(spark, out).select(*READING_SCHEMA.names, "reading_date")


def land(df, path):
    df.withColumn("reading_date", F.to_date("timestamp")).write.mode("append").partitionBy("reading_date").parquet(path)


@pytest.fixture
def source(make_readings):
    return make_readings(
        {"hanoi": [(h, float(h % 9)) for h in range(60)], "hcm": [(h, float(h % 5)) for h in range(60) if h % 13]}
    )


@pytest.fixture
def models(source):
    table = training.training_table(source, HOURS, [1, 6])
    return training.train_horizons(table, HOURS, [1, 6], training.forest(ForestConfig(trees=2, depth=3)))


def run_forecasts(spark, tmp_path, models, run_id="run", lookback=24, config=HOURS):
    landed, rows, out = (str(tmp_path / n) for n in ("landed", "rows", "forecasts"))
    history = lambda s: readers.read_landed(s, landed)
    stream = streams.reading_stream(spark, landed)
    finish(forecast.feature_stream(stream, history, rows, str(tmp_path / "s1"), run_id, config, lookback, ONCE))
    finish(forecast.score_stream(spark, rows, models, out, str(tmp_path / "s2"), config, ONCE))
    return readers.read_forecasts(spark, out).select(FORECAST_SCHEMA.names)


def test_restart_lands_nothing_twice(spark, source, tmp_path):
    put(source, tmp_path / "in")
    assert rows_of(ingest(spark, tmp_path).drop("reading_date")) == rows_of(source)
    assert rows_of(ingest(spark, tmp_path).drop("reading_date")) == rows_of(source)
    put(source.limit(1), tmp_path / "in")
    assert ingest(spark, tmp_path).count() == source.count() + 1


def test_repeats_within_the_delay_are_dropped(spark, source, tmp_path):
    put(source, tmp_path / "in")
    ingest(spark, tmp_path, dedupe_within="10 days")
    put(source.limit(5), tmp_path / "in")
    assert rows_of(ingest(spark, tmp_path, dedupe_within="10 days").drop("reading_date")) == rows_of(source)


def test_late_readings(spark, make_readings, tmp_path):
    first = make_readings({"a": [(100, 1.0)]})
    within, beyond = make_readings({"a": [(99, 2.0)]}), make_readings({"a": [(10, 3.0)]})
    put(first, tmp_path / "in")
    ingest(spark, tmp_path, dedupe_within="2 hours")
    put(within.unionByName(beyond), tmp_path / "in")
    landed = ingest(spark, tmp_path, dedupe_within="2 hours")
    assert rows_of(landed.select("pm25")) == [(1.0,), (2.0,), (3.0,)]


def test_a_corrected_reading_is_no_repeat(spark, make_readings, tmp_path):
    put(make_readings({"a": [(1, 50.0)]}), tmp_path / "in")
    ingest(spark, tmp_path, dedupe_within="2 hours")
    put(make_readings({"a": [(1, 10.0)]}), tmp_path / "in")
    assert rows_of(ingest(spark, tmp_path, dedupe_within="2 hours").select("pm25")) == [(10.0,), (50.0,)]
    newest = keep_last(readers.read_landed(spark, str(tmp_path / "out")), ["ingested_at", "source_offset"])
    assert rows_of(newest.select("pm25")) == [(10.0,)]


def test_rejects_are_no_repeats_of_each_other(spark, source, tmp_path):
    put(source, tmp_path / "in")
    (tmp_path / "in" / "bad.txt").write_text("oops\noops\n\n")
    assert ingest(spark, tmp_path, dedupe_within="2 hours").count() == source.count()
    bad = readers.read_rejects(spark, str(tmp_path / "out"))
    assert rows_of(bad.select("value", "reject_reason")) == [("", "not json"), ("oops", "not json"), ("oops", "not json")]


def test_rejects_are_kept(spark, source, tmp_path):
    put(source, tmp_path / "in")
    (tmp_path / "in" / "bad.txt").write_text("oops\n" + json.dumps({"location_id": "a", "timestamp": "soon"}) + "\n")
    landed = ingest(spark, tmp_path)
    assert landed.count() == source.count()
    bad = readers.read_rejects(spark, str(tmp_path / "out"))
    assert sorted(r.reject_reason for r in bad.collect()) == ["not json", "unreadable time"]


@pytest.mark.parametrize(
    "step, lookback, per_chunk", [("hours", 3, 1000), ("hours", 24, 10), ("rows", None, 1000), ("rows", None, 10)]
)
def test_stream_forecasts_equal_batch_forecasts(spark, source, models, tmp_path, step, lookback, per_chunk):
    config = replace(HOURS, step=step, chunking=Chunking(per_chunk))
    cut = F.col("timestamp") < F.lit("2024-01-02 12:00:00").cast("timestamp")
    land(source.filter(cut), str(tmp_path / "landed"))
    run_forecasts(spark, tmp_path, models, lookback=lookback, config=config)
    land(source.filter(~cut), str(tmp_path / "landed"))
    streamed = run_forecasts(spark, tmp_path, models, lookback=lookback, config=config)
    rows = complete(build_features(source, config), config)
    batch = training.forecasts_long(training.score_horizons(rows, models), [1, 6])
    assert rows_of(streamed) == rows_of(batch)


def test_forecast_keys_are_unique_after_a_replay(spark, source, models, tmp_path):
    landed, rows = str(tmp_path / "landed"), str(tmp_path / "rows")
    land(source, landed)
    first = run_forecasts(spark, tmp_path, models)
    before = rows_of(first)
    # The same micro-batch once more, as after a crash between output and commit.
    batch = readers.read_landed(spark, landed)
    forecast.feature_batch(batch, 0, lambda s: readers.read_landed(s, landed), rows, "run", HOURS, 24)
    after = run_forecasts(spark, tmp_path, models)
    assert rows_of(after) == before
    assert after.select("location_id", "timestamp", "horizon_hours").distinct().count() == len(before)


def test_late_reading_gets_its_own_forecast(spark, source, models, tmp_path):
    late = (F.col("location_id") == "hanoi") & (F.col("timestamp") == F.lit("2024-01-01 20:00:00").cast("timestamp"))
    land(source.filter(~late), str(tmp_path / "landed"))
    assert run_forecasts(spark, tmp_path, models).filter(late).count() == 0
    land(source.filter(late), str(tmp_path / "landed"))
    assert run_forecasts(spark, tmp_path, models).filter(late).count() == 2


def test_one_model_gives_one_horizon(spark, source, models, tmp_path):
    land(source, str(tmp_path / "landed"))
    got = run_forecasts(spark, tmp_path, {1: models[1]})
    assert rows_of(got.select("horizon_hours").distinct()) == [(1,)]


def test_streams_start_before_anything_landed(spark, source, models, tmp_path):
    landed, rows, out = (str(tmp_path / n) for n in ("landed", "rows", "forecasts"))
    history = lambda s: readers.read_landed(s, landed)
    first = forecast.feature_stream(streams.reading_stream(spark, landed), history, rows, str(tmp_path / "s1"), "run")
    second = forecast.score_stream(spark, rows, models, out, str(tmp_path / "s2"))
    first.processAllAvailable()
    second.processAllAvailable()
    land(source, landed)
    first.processAllAvailable()
    second.processAllAvailable()
    first.stop()
    second.stop()
    expected = complete(build_features(source, HOURS), HOURS).count() * 2
    assert spark.read.parquet(out).count() == expected > 0


def test_ingest_feeds_the_feature_stream(spark, source, models, tmp_path):
    """From messages to forecasts through the folder the ingest job owns."""
    put(source, tmp_path / "in")
    ingest(spark, tmp_path, dedupe_within="10 days")
    landed, rows = str(tmp_path / "out"), str(tmp_path / "rows")
    history = lambda s: readers.read_landed(s, landed)
    stream = streams.reading_stream(spark, landed)
    finish(forecast.feature_stream(stream, history, rows, str(tmp_path / "s1"), "run", HOURS, 24, ONCE))
    finish(forecast.score_stream(spark, rows, models, str(tmp_path / "f"), str(tmp_path / "s2"), HOURS, ONCE))
    batch = training.forecasts_long(
        training.score_horizons(complete(build_features(source, HOURS), HOURS), models), [1, 6]
    )
    assert rows_of(readers.read_forecasts(spark, str(tmp_path / "f")).select(FORECAST_SCHEMA.names)) == rows_of(batch)


def test_empty_batch_writes_nothing(spark, source, tmp_path):
    history = lambda s: source
    forecast.feature_batch(source.filter("false"), 0, history, str(tmp_path / "rows"), "run", HOURS, 24)
    assert not (tmp_path / "rows").exists()


def test_bounded_history_holds_every_dependency(source):
    keys = source.filter("timestamp > '2024-01-03 00:00:00'").select("location_id", "timestamp")
    near = forecast.features_of(source, keys, HOURS, 3)
    full = forecast.features_of(source, keys, HOURS, None)
    assert near.count() > 0
    assert rows_of(near) == rows_of(full)


def test_too_short_lookback_is_refused(source):
    with pytest.raises(ValueError):
        forecast.feature_stream(source, lambda s: source, "x", "y", "run", HOURS, lookback_hours=2)
    with pytest.raises(ValueError):
        forecast.feature_stream(source, lambda s: source, "x", "y", "run", replace(HOURS, step="rows"), lookback_hours=24)


def test_corrected_reading_counts(spark, source):
    """Of several versions of a reading features see the one that landed last, not the largest."""
    hour = "timestamp = timestamp'2024-01-01 02:00:00'"
    first = source.withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp"))
    fixed = first.filter(hour).withColumns(
        {"pm25": F.lit(-5.0), "ingested_at": F.lit("2024-02-02").cast("timestamp")}
    )
    keys = source.filter("timestamp = timestamp'2024-01-01 03:00:00'").select("location_id", "timestamp")
    got = forecast.features_of(first.unionByName(fixed), keys, HOURS, 24).collect()
    assert got and all(r["pm25_lag1"] == -5.0 for r in got)


def test_alerts_on_a_stream(spark, source, tmp_path):
    land(source.withColumn("aqi", F.col("pm25") * 15), str(tmp_path / "landed"))
    stream = reports.alerts(streams.reading_stream(spark, str(tmp_path / "landed")), "aqi", 5, AQI_BANDS)
    out, state = str(tmp_path / "alerts"), str(tmp_path / "state")
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(**ONCE).start())
    got = spark.read.parquet(out)
    assert got.count() == source.filter("pm25 * 15 > 100").count() > 0
