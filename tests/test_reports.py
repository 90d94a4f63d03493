from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.functions.bands import PM25_BANDS
from sensorcast.operators import series
from sensorcast.plans import reports
from sensorcast.plans import training
from sensorcast.plans.training import persistence_forecasts
from sensorcast.schema import FORECAST_SCHEMA


def test_detail_without_any_forecast(spark, make_readings):
    df = make_readings({"hanoi": [(0, 1.0), (1, 4.0)], "hcm": [(5, 130.0)]})
    none = spark.createDataFrame([], FORECAST_SCHEMA)
    rows = {r.location_id: r for r in reports.station_detail(df, none, 3).collect()}
    assert (rows["hanoi"].pm25_delta, rows["hcm"].pm25_delta) == (3.0, 0.0)
    assert {r.status for r in rows.values()} == {"waiting"}
    assert rows["hcm"].forecast_quality is None
    assert rows["hcm"].quality_colour == "red"
    assert rows["hcm"].reading_time_local == "01/01/2024 12:00"


def test_detail_with_forecast(make_readings):
    df = make_readings({"hanoi": [(0, 1.0), (1, 26.0)]})
    row = reports.station_detail(df, persistence_forecasts(df, [1, 2]), 2).first()
    assert (row.status, row.predicted_pm25, row.forecast_colour) == ("ready", 26.0, "orange")
    assert row.forecast_time_local == "01/01/2024 10:00"


def test_recent_rows_of_every_station(make_readings):
    df = make_readings({"a": [(h, float(h)) for h in range(30)], "b": [(0, 0.0)]})
    rows = reports.recent_readings(df).select("location_id", "recency", "pm25")
    got = rows_of(rows)
    assert len(got) == 21
    assert ("a", 1, 29.0) in got and ("a", 20, 10.0) in got and ("b", 1, 0.0) in got


def test_nearest_prefers_the_earlier_on_a_tie(make_readings):
    df = make_readings({"a": [(0, 1.0), (2, 2.0)], "b": [(0, 1.0), (1, 3.0), (2, 2.0)]})
    got = series.nearest(df, F.lit("2024-01-01 01:00:00").cast("timestamp")).select("location_id", "pm25")
    assert rows_of(got) == [("a", 1.0), ("b", 3.0)]


def test_latest_and_nearest_sort_few_rows(make_readings):
    df = make_readings({"a": [(0, 1.0), (2, 2.0), (2, 2.0)], "b": [(5, 1.0)], "none": [(1, 7.0), (3, 9.0)]})
    df = df.withColumn("location_id", F.nullif("location_id", F.lit("none")))
    odd = df.unionByName(df.limit(1).withColumns({"location_id": F.lit("c"), "timestamp": F.lit(None).cast("timestamp")}))
    assert sorted(r.pm25 for r in series.latest(odd).filter("location_id is null or location_id <> 'c'").collect()) == [1.0, 2.0, 9.0]
    assert [r.timestamp for r in series.latest(odd).filter("location_id = 'c'").collect()] == [None]
    assert series.latest(df.limit(0)).count() == 0
    for found in (series.latest(df), series.nearest(df, F.lit("2024-01-01 01:00:00").cast("timestamp"))):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        below = plan[plan.index("LeftSemi"):]
        assert "SortAggregate" not in below and "HashAggregate" in below and "CartesianProduct" not in plan


def test_last_days_follow_each_stations_own_end(make_readings):
    df = make_readings({"a": [(0, 1.0), (23, 2.0), (24, 3.0)], "b": [(0, 1.0)]})
    assert rows_of(series.last_days(df, 1).select("location_id", "pm25")) == [("a", 2.0), ("a", 3.0), ("b", 1.0)]


def test_station_list_is_sorted_by_name(make_readings):
    df = make_readings({"b": [(0, 1.0), (1, 1.0)], "a": [(0, 1.0)]})
    assert [r.location_name for r in series.station_list(df).collect()] == ["A", "B"]


def test_forecast_vs_actual(make_readings):
    df = make_readings({"a": [(0, 1.0), (1, 4.0)]})
    got = reports.forecast_vs_actual(persistence_forecasts(df, [1, 2]), df).select("horizon_hours", "error")
    assert rows_of(got) == [(1, 3.0)]


def test_find_forecast(make_readings):
    forecasts = persistence_forecasts(make_readings({"a": [(0, 1.0)], "b": [(0, 2.0)]}), [1, 2])
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert rows_of(reports.find_forecast(forecasts, "b", at, 2).select("predicted_pm25")) == [(2.0,)]


def test_alerts_on_forecasts(make_readings):
    forecasts = persistence_forecasts(make_readings({"a": [(0, 76.0)], "b": [(0, 50.0)]}), [1])
    got = reports.alerts(forecasts, "predicted_pm25", 4, PM25_BANDS).select("location_id", "alert_level")
    assert rows_of(got) == [("a", 5)]


def test_colour_ceiling(make_readings):
    low, high = make_readings({"a": [(0, 5.0)]}), make_readings({"a": [(0, 150.0)]})
    assert reports.colour_ceiling(low).first()[0] == 100.0
    assert reports.colour_ceiling(high).first()[0] == 150.0


def test_history_is_in_time_order(make_readings):
    df = make_readings({"a": [(3, 1.0), (1, 2.0)]})
    late = df.withColumn("timestamp", F.lit(None).cast("timestamp"))
    assert [r.pm25 for r in reports.clean_history(df.unionByName(late)).collect()] == [2.0, 1.0]


def test_repeats_do_not_multiply(spark, make_readings):
    readings = make_readings({"a": [(0, 1.0), (1, 2.0)]})
    forecasts = training.persistence_forecasts(readings, [1]).withColumn("run_id", F.lit("run-1"))
    later = forecasts.withColumns({"run_id": F.lit("run-2"), "predicted_pm25": F.lit(9.0)})
    both = later.unionByName(forecasts)
    twice = readings.unionByName(readings)
    assert [r["error"] for r in reports.forecast_vs_actual(both, twice).collect()] == [2.0 - 9.0]
    newest = readings.filter("timestamp = timestamp'2024-01-01 01:00:00'")
    assert [r["predicted_pm25"] for r in reports.forecast_lookup(newest, both, 1).collect()] == [9.0]
