import random
import re
from dataclasses import replace

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.config import Chunking, FeatureConfig, SplitConfig
from sensorcast.functions import calendar
from sensorcast.functions.stations import attach_dimension, station_code, station_dimension
from sensorcast.plans.features import build_features, chronological_split, complete, labels_long, with_shifts

CONFIG = FeatureConfig()
HOURS = FeatureConfig(step="hours")


def test_feature_order():
    assert CONFIG.features == [
        "pm25", "pm10", "co", "no2", "so2", "o3", "aqi",
        "pm25_lag1", "pm25_lag3", "pm25_mean3", "hour", "day_of_week", "location_code",
    ]


def test_values_of_a_known_row(make_readings):
    df = make_readings({"hanoi": [(h, float(h)) for h in range(6)]})
    rows = complete(build_features(df, CONFIG, [1]), CONFIG, ["target_h1"])
    assert rows.count() == 2
    row = rows.orderBy("timestamp").first()
    assert (row.pm25_lag1, row.pm25_lag3, row.pm25_mean3, row.hour, row.location_code, row.target_h1) == (
        2.0, 0.0, 1.0, 3.0, 2.0, 4.0,
    )
    # 1 January 2024 was a Monday.
    assert row.day_of_week == pytest.approx(1.125)


def test_short_station_has_no_features(make_readings):
    df = make_readings({"a": [(h, 1.0) for h in range(3)], "b": [(h, 1.0) for h in range(4)]})
    rows = complete(build_features(df, CONFIG), CONFIG)
    assert [r.location_id for r in rows.collect()] == ["b"]


def test_gap_shifts_row_lags_but_not_hour_lags(make_readings):
    df = make_readings({"a": [(h, float(h)) for h in (0, 1, 2, 3, 10, 11)]})
    at_10 = F.col("timestamp") == F.lit("2024-01-01 10:00:00").cast("timestamp")
    by_row = build_features(df, CONFIG, [1]).filter(at_10).first()
    by_hour = build_features(df, HOURS, [1]).filter(at_10).first()
    assert (by_row.pm25_lag1, by_row.target_h1) == (3.0, 11.0)
    assert (by_hour.pm25_lag1, by_hour.pm25_mean3, by_hour.target_h1) == (None, None, 11.0)


def test_both_steps_agree_without_gaps(make_readings):
    df = make_readings({"a": [(h, float(h * h % 11)) for h in range(40)], "b": [(h, float(h)) for h in range(30)]})
    by_row = complete(build_features(df, CONFIG, [1, 5]), CONFIG)
    by_hour = complete(build_features(df, HOURS, [1, 5]), HOURS)
    assert rows_of(by_row) == rows_of(by_hour)


@pytest.mark.parametrize("config", [CONFIG, HOURS])
def test_features_ignore_the_future(make_readings, config):
    past = [(h, float(h % 5)) for h in range(20)]
    one = make_readings({"a": past + [(20, 1.0), (21, 2.0)]})
    other = make_readings({"a": past + [(20, 99.0), (22, 50.0)]})
    until = F.col("timestamp") < F.lit("2024-01-01 20:00:00").cast("timestamp")
    assert rows_of(build_features(one, config).filter(until)) == rows_of(build_features(other, config).filter(until))


def test_rows_without_time_or_station_are_left_out(make_readings):
    df = make_readings({"a": [(h, float(h)) for h in range(6)]})
    stray = df.limit(2).withColumn("timestamp", F.lit(None).cast("timestamp"))
    nameless = df.limit(2).withColumn("location_id", F.lit(None).cast("string"))
    assert rows_of(build_features(df.unionByName(stray).unionByName(nameless), CONFIG)) == rows_of(build_features(df, CONFIG))


def test_null_and_nan_measures_are_not_complete(spark, make_readings):
    df = make_readings({"a": [(h, 1.0) for h in range(6)]})
    hour = F.hour("timestamp")
    df = df.withColumn("co", F.when(hour == 4, F.lit(None)).when(hour == 5, F.lit(float("nan"))).otherwise(F.col("co")))
    rows = complete(build_features(df, CONFIG), CONFIG)
    assert [r.hour for r in rows.collect()] == [3.0]


def test_unknown_station_code(spark):
    codes = [("a", 0.0)]
    df = spark.createDataFrame([("a",), ("z",)], "s string")
    assert rows_of(df.select(station_code(F.col("s"), codes, 3.0))) == [(0.0,), (3.0,)]
    assert rows_of(df.select(station_code(F.col("s"), codes, None))) == [(0.0,), (None,)]
    assert rows_of(df.select(station_code(F.col("s"), [], None))) == [(None,), (None,)]


def test_dimension(spark, make_readings):
    df = make_readings({"hanoi": [(0, 1.0)], "elsewhere": [(0, 1.0)]})
    joined = attach_dimension(df, station_dimension(spark), ["region_iso"]).select("location_id", "region_iso")
    assert rows_of(joined) == [("elsewhere", None), ("hanoi", "VN-HN")]


def test_labels_long(make_readings):
    df = make_readings({"a": [(0, 1.0), (1, 2.0), (2, 3.0)]})
    wide = build_features(df, CONFIG, [1, 2])
    assert rows_of(labels_long(wide, [1, 2], ["pm25"])) == [
        (1.0, 1, 2.0), (1.0, 2, 3.0), (2.0, 1, 3.0), (2.0, 2, None), (3.0, 1, None), (3.0, 2, None),
    ]


@pytest.mark.parametrize("chunked", [False, True])
def test_split_is_a_prefix_per_station(make_readings, chunked):
    df = make_readings({"a": [(h, 1.0) for h in range(10)], "b": [(h, 1.0) for h in range(25)]})
    chunking = replace(CONFIG.chunking, rows_per_chunk=4) if chunked else None
    parts = chronological_split(df, SplitConfig(train=0.6, validation=0.2, purge=2), chunking)
    counts = {(r.location_id, r.part): (r.n, r.first, r.last) for r in parts.groupBy("location_id", "part").agg(
        F.count("*").alias("n"), F.min("series_rank").alias("first"), F.max("series_rank").alias("last")).collect()}
    assert counts["a", "train"] == (4, 1, 4)
    assert counts["a", "test"] == (2, 9, 10)
    assert counts["b", "train"] == (13, 1, 13)
    assert counts["b", "validation"] == (3, 16, 18)
    assert counts["b", None] == (4, 14, 20)
    assert counts["b", "test"] == (5, 21, 25)


def test_calendar_before_the_epoch(spark):
    df = spark.sql("SELECT timestamp '1969-12-31 12:00:00' AS ts")  # a Wednesday
    row = df.select(calendar.day_of_week_fraction(F.col("ts")), calendar.day_of_week(F.col("ts"))).first()
    assert tuple(row) == (3.5, 3)


def test_display_time(spark):
    df = spark.sql("SELECT timestamp '2024-03-31 20:05:00' AS ts")
    assert df.select(calendar.display_time(F.col("ts"))).first()[0] == "01/04/2024 03:05"


OFF_HOUR = replace(HOURS, tolerance_minutes=20)


@pytest.mark.parametrize("chunking", [None, Chunking(), Chunking(rows_per_chunk=20)])
def test_readings_off_the_hour(make_readings, chunking):
    """The nearest reading within the tolerance, the earlier of two, with gaps and readings every few minutes."""
    rnd = random.Random(7)
    minutes = {"a": [0], "b": [0]}
    for station, steps in (("a", [1, 2, 5]), ("b", [10, 60, 200])):
        for _ in range(150):
            minutes[station].append(minutes[station][-1] + rnd.choice(steps))
    series = {s: [(m / 60, float(i)) for i, m in enumerate(of)] for s, of in minutes.items()}

    def near(station, minute):
        found = [(abs(m - minute), m, float(i)) for i, m in enumerate(minutes[station]) if abs(m - minute) <= 20]
        return min(found)[2] if found else None

    config = replace(OFF_HOUR, chunking=chunking)
    got = build_features(make_readings(series), config, [1, 2]).collect()
    assert "_next" not in got[0].asDict() and "_at" not in got[0].asDict()
    found = {(r.location_id, r.pm25): (r.pm25_lag1, r.pm25_lag3, r.target_h1, r.target_h2) for r in got}
    wanted = {(s, float(i)): tuple(near(s, m + 60 * h) for h in (-1, -3, 1, 2)) for s, of in minutes.items() for i, m in enumerate(of)}
    assert found == wanted


def test_off_the_hour_with_repeated_instants(make_readings):
    """Readings that come several times do not hide what follows them, however rows are sorted."""
    series = {"a": [(h, v) for h, v in ((0, 1.0), (0.75, 2.0), (1.25, 3.0)) for _ in range(3)]}
    got = build_features(make_readings(series), replace(OFF_HOUR, chunking=None), [1])
    assert [r.target_h1 for r in got.orderBy("timestamp").collect()] == [2.0] * 3 + [None] * 6
    late = {"a": [(h, v) for h, v in ((0, 1.0), (0.5, 2.0), (1.25, 3.0)) for _ in range(3)]}
    got = build_features(make_readings(late), replace(OFF_HOUR, chunking=None), [1])
    assert [r.target_h1 for r in got.orderBy("timestamp").collect()] == [3.0] * 6 + [None] * 3


def test_off_the_hour_work_grows_with_rows(make_readings):
    """A frame of the tolerance is read anew for each row, and holds the more rows the denser they are."""
    rows = build_features(make_readings({"a": [(h / 4, 1.0) for h in range(40)]}), OFF_HOUR, [1, 6])
    plan = rows.select("pm25_lag1", "pm25_lag3", "target_h1", "target_h6")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and not re.search(r"RangeFrame, -?\d", plan)


def test_means_off_the_hour(spark, make_readings):
    """Against sums by hand: gaps, ends of ranges at a reading, missing values, NaN, before 1970, several chunks."""
    hours = sorted({round(n * 0.37 % 90, 2) - 20 for n in range(700)} | {float(h) for h in range(0, 60, 5)} | {-600_000.25, -600_000.0, 400.0})
    points = [(h, None if i % 13 == 0 else float(i * 7 % 50)) for i, h in enumerate(hours)]
    values = {s: [(h, (float("nan") if v is not None and s == "b" and i == 200 else v)) for i, (h, v) in enumerate(points)] for s in ("a", "b")}
    flat = [(s, round(h * 3600 * 1e6), v) for s, ps in values.items() for h, v in ps]
    df = spark.createDataFrame(flat, "location_id string, at long, pm25 double")
    start = 1_704_067_200_000_000
    df = df.withColumn("timestamp", F.timestamp_micros(F.col("at") + start))
    for rows in (1_000_000, 60):
        config = FeatureConfig(step="hours", tolerance_minutes=20, lags=(1,), means=(1, 3), chunking=Chunking(rows_per_chunk=rows))
        got = with_shifts(df, config)
        for k in (1, 3):
            found = {(r.location_id, r["at"]): r[f"pm25_mean{k}"] for r in got.select("location_id", "at", f"pm25_mean{k}").collect()}
            assert len(found) == len(flat)
            for s, at, _ in flat:
                near = [v for t, u, v in flat if t == s and at - k * 3_600_000_000 <= u < at and v is not None]
                mean = found[s, at]
                if not near:
                    assert mean is None
                else:
                    expected = sum(near) / len(near)
                    assert mean == pytest.approx(expected, rel=1e-12, nan_ok=True)
        assert not [c for c in got.columns if c.startswith(("_slot", "_rest", "_next"))]


def test_means_off_the_hour_are_read_once(make_readings):
    """No window reads a range of hours anew for every row."""
    config = FeatureConfig(step="hours", tolerance_minutes=20)
    plan = with_shifts(make_readings({"a": [(1, 1.0)]}), config)._jdf.queryExecution().analyzed().toString()
    assert "avg(" not in plan and "RangeFrame, -10800000000" not in plan
