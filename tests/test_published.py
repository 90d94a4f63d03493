from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.operators import series
from sensorcast.plans import reports, training
from sensorcast.schema import READING_SCHEMA
from sensorcast.sources import published, readers
from sensorcast.streaming import recent


def test_only_named_attempts_are_read(spark, make_readings, tmp_path):
    path = str(tmp_path / "table")
    rows = make_readings({"a": [(h, float(h)) for h in range(6)]})
    schema = rows.schema
    assert published.read_published(spark, path, schema).count() == 0
    lost = published.write_attempt(rows.limit(3), path, "r", 0)
    assert published.read_published(spark, path, schema).count() == 0
    published.publish_batch(rows, path, "r", 0)
    published.publish_batch(rows.limit(1), path, "r", 0)  # a replay
    assert rows_of(published.read_published(spark, path, schema).drop("run_id", "batch_id")) == rows_of(rows)
    # Two workers that both name their attempt: the first counts, for every reader alike.
    published.commit(spark, path, "r", 0, lost)
    assert published.read_published(spark, path, schema).count() == 6
    published.publish_batch(rows.limit(2), path, "r", 1)
    published.publish_batch(rows.limit(2), path, "other", 0)
    assert published.read_published(spark, path, schema).count() == 10
    assert published.is_published(spark, path, "r", 1) and not published.is_published(spark, path, "r", 2)


def test_newest_batch(spark, make_readings, tmp_path):
    path = str(tmp_path / "table")
    rows = make_readings({"a": [(h, float(h)) for h in range(6)]})
    assert published.read_newest(spark, path, rows.schema).count() == 0
    for n in (3, 5, 2):
        published.publish_batch(rows.limit(n), path, "r", n)
    assert published.read_newest(spark, path, rows.schema).count() == 2


def test_recent_table(spark, make_readings, tmp_path):
    path = str(tmp_path / "recent")
    stamp = lambda df, when: df.withColumns(
        {"ingested_at": F.lit(when).cast("timestamp"), "source_offset": F.lit(0).cast("long")}
    )
    first = make_readings({"a": [(h, float(h)) for h in range(9)], "b": [(1, 1.0)]})
    second = make_readings({"a": [(9, 9.0), (7, -7.0), (2, 50.0)], "c": [(0, 5.0)]})  # new, corrected, and old ones
    recent.merge_batch(stamp(first, "2024-02-01"), 0, path, "r", rows=3)
    recent.merge_batch(stamp(second, "2024-02-02"), 1, path, "r", rows=3)
    want = [("a", -7.0), ("a", 8.0), ("a", 9.0), ("b", 1.0), ("c", 5.0)]
    assert rows_of(recent.read_recent(spark, path).select("location_id", "pm25")) == sorted(want, key=str)
    # The same batch again, published or not, changes nothing.
    recent.merge_batch(stamp(second, "2024-02-02"), 1, path, "r", rows=3)
    recent.merge_batch(stamp(first, "2024-02-01"), 2, path, "r", rows=3)
    assert rows_of(recent.read_recent(spark, path).select("location_id", "pm25")) == sorted(want, key=str)


def test_lookup_reads_only_the_dates_it_needs(spark, make_readings, tmp_path):
    source = make_readings({"a": [(h, float(h)) for h in range(24 * 30)], "b": [(h, float(h)) for h in range(24 * 29)]})
    made = training.persistence_forecasts(source, [1, 6]).withColumns(
        {"revision": F.lit(0).cast("long"), "scored_at": F.current_timestamp(), "forecast_date": F.to_date("timestamp")}
    )
    made.write.partitionBy("forecast_date").parquet(str(tmp_path / "f"))
    stamped = source.withColumns({"ingested_at": F.current_timestamp(), "source_offset": F.lit(0).cast("long")})
    recent.merge_batch(stamped, 0, str(tmp_path / "recent"), "r")
    newest = series.recent(recent.read_recent(spark, str(tmp_path / "recent")).select(READING_SCHEMA.names), 1)
    found = reports.forecast_lookup(newest.select("location_id", "timestamp", "pm25"), readers.read_forecasts(spark, str(tmp_path / "f")), 6)
    assert rows_of(found.select("location_id", "predicted_pm25", "status")) == [("a", 719.0, "ready"), ("b", 695.0, "ready")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    one = reports.find_forecast(readers.read_forecasts(spark, str(tmp_path / "f")), "a", F.lit("2024-01-05 03:00:00").cast("timestamp"), 6)
    assert one.count() == 1
    scan = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "forecast_date" in scan.split("PushedFilters")[0]
