import json
import math
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.functions import bands, casts
from sensorcast.operators import clean, metrics, profile
from sensorcast.operators.quantiles import quantiles


def test_decode_sorts_out_bad_messages(spark):
    good = {"location_id": "a", "timestamp": "2024-01-01T05:00", "pm25": 1.5, "aqi": "7"}
    texts = [
        json.dumps(good),
        json.dumps(good | {"pm25": "high"}),
        json.dumps(good | {"timestamp": "soon"}),
        json.dumps({k: v for k, v in good.items() if k != "timestamp"}),
        json.dumps({k: v for k, v in good.items() if k != "location_id"}),
        "{broken",
        "",
        None,
    ]
    messages = spark.createDataFrame([(t.encode() if t is not None else None,) for t in texts], "value binary")
    decoded = clean.decode_messages(messages)
    assert rows_of(clean.accepted(decoded).select("location_id", "timestamp", "pm25", "aqi")) == [
        ("a", "2024-01-01 05:00:00", 1.5, 7.0),
        ("a", "2024-01-01 05:00:00", None, 7.0),
    ]
    reasons = sorted(r.reject_reason for r in clean.rejected(decoded).collect())
    assert reasons == ["no station", "no time", "not json", "not json", "not json", "unreadable time"]
    assert clean.rejected(decoded).filter("value = '{broken'").count() == 1


def test_instants_in_a_source_zone(spark):
    texts = ["2024-01-01T07:00", "2024-01-01T07:00:00Z", "2024-01-01 07:00:00.25+07:00", "never", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    local = [r[0] for r in df.select(casts.to_instant(F.col("t"), "Asia/Bangkok").cast("string")).collect()]
    assert local == ["2024-01-01 00:00:00", "2024-01-01 07:00:00", "2024-01-01 00:00:00.25", None, None]
    plain = [r[0] for r in df.select(casts.to_instant(F.col("t")).cast("string")).collect()]
    assert plain == ["2024-01-01 07:00:00", "2024-01-01 07:00:00", "2024-01-01 00:00:00.25", None, None]


def test_sensor_rows(spark):
    raw = spark.createDataFrame(
        [("10/03/2004", "18.00.00", "2,6", "-200"), ("10/03/2004", "19.00.00", "-200,0", "9"), ("x", "y", "", None)],
        "Date string, Time string, co string, no2 string",
    ).withColumn("_c15", F.lit(""))
    cleaned = clean.clean_sensor_rows(raw, ["co", "no2"])
    assert "_c15" not in cleaned.columns
    assert rows_of(cleaned.select("timestamp", "co", "no2")) == [
        ("2004-03-10 18:00:00", 2.6, None),
        ("2004-03-10 19:00:00", None, 9.0),
        (None, None, None),
    ]


def test_null_sentinel(spark):
    df = spark.createDataFrame([(-200.0, 1.0), (2.0, -200.0), (None, 3.0)], "a double, b double")
    assert rows_of(clean.null_sentinel(df, ["a"])) == [(2.0, -200.0), (None, 1.0), (None, 3.0)]


def test_keep_last(spark):
    rows = [("a", "t1", 1, 5.0), ("a", "t1", 3, 7.0), ("a", "t1", 2, 6.0), ("b", "t1", 1, 8.0)]
    df = spark.createDataFrame(rows, "location_id string, timestamp string, seq int, pm25 double")
    assert rows_of(clean.keep_last(df, ["seq"])) == [("a", "t1", 3, 7.0), ("b", "t1", 1, 8.0)]


def test_ranges(spark):
    df = spark.createDataFrame([(1.0, 5.0), (0.0, 5.0), (None, 9.0), (float("nan"), 5.0)], "a double, b double")
    bounds = {"a": (0.5, None), "b": (None, 5.0)}
    assert rows_of(clean.null_out_of_range(df, bounds)) == [(1.0, 5.0), (None, 5.0), (None, 5.0), (None, None)]
    assert sorted(r[0] for r in clean.flag_out_of_range(df, bounds).select("out_of_range").collect()) == ["", "a", "a", "b"]


def test_quantile_bounds(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("pm25"))
    assert rows_of(clean.quantile_bounds(df, ["pm25"], 0.1, 0.9)) == [("pm25", 100.0, 900.0)]


@pytest.mark.parametrize("cells, few", [(4096, 1_000_000), (2, 1), (7, 20)])
def test_quantiles_against_sorting(spark, cells, few):
    rnd = random.Random(cells)
    columns = {
        "even": [rnd.uniform(-5, 5) for _ in range(500)],
        "outlier": [rnd.random() for _ in range(499)] + [1e12],
        "heavy": [3.0] * 400 + [rnd.random() * 9 for _ in range(100)],
        "same": [7.0] * 500,
        "holes": [None if i % 3 else (float("nan") if i % 2 else float(i)) for i in range(500)],
        "empty": [None] * 500,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    probabilities = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    expected = []
    for name, values in columns.items():
        known = sorted(v for v in values if v is not None and v == v)
        expected += [(name, p, known[max(1, math.ceil(p * len(known))) - 1]) for p in probabilities if known]
    assert rows_of(quantiles(df, list(columns), probabilities, cells, few)) == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_band_bounds_are_inclusive(spark):
    values = [0.0, 20.0, 20.5, 100.0, 100.1, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    levels = [r[0] for r in df.select(bands.band_level(F.col("v"), bands.AQI_BANDS)).collect()]
    assert levels == [0, 0, 1, 4, 5, None, None]
    guidance = df.select(bands.band_guidance(F.col("v"), bands.PM25_BANDS).alias("g")).first().g
    assert (guidance.label, guidance.colour) == ("Thấp", "green")


def test_rating(spark):
    df = spark.createDataFrame([(v,) for v in (0.85, 0.8, 0.65, 0.1, None)], "r double")
    assert [r[0] for r in df.select(bands.rating(F.col("r"))).collect()] == [
        "Rất xuất sắc", "Tốt", "Khá tốt", "Đạt yêu cầu", None,
    ]


def test_metrics_against_hand_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 1.0), (None, 1.0), (1.0, None)], "y double, p double")
    row = metrics.regression_metrics(df, F.col("y"), F.col("p")).first()
    assert row.rows == 3
    assert row.mae == pytest.approx(2 / 3)
    assert row.rmse == pytest.approx((2 / 3) ** 0.5)
    assert row.r2 == pytest.approx(1 - 2 / (14 / 3))
    assert row.mape == pytest.approx(0.5)


def test_metrics_of_a_constant_series(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(df, F.col("y"), F.col("p")).first().r2 is None


def test_band_scores_of_a_band_never_forecast(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x"), ("y", "x"), (None, "x")], "a string, f string")
    scores = metrics.band_scores(metrics.confusion(df, F.col("a"), F.col("f")))
    got = {r.band: (r.actual_rows, r.forecast_rows, r.hits, r.precision, r.recall, r.accuracy) for r in scores.collect()}
    assert got["x"] == (2, 3, 2, pytest.approx(2 / 3), 1.0, pytest.approx(2 / 3))
    assert got["y"] == (1, 0, 0, None, 0.0, pytest.approx(2 / 3))


def test_profile_of_repeats_and_gaps(make_readings):
    df = make_readings({"a": [(0, 1.0), (0, 1.0), (1, None), (4, 9.0)], "b": [(0, 1.0)]})
    row = profile.profile(df, ["pm25"], {"pm25": (None, 5.0)}).first()
    assert (row.rows, row.stations, row.repeated_keys, row.pm25_null, row.pm25_out) == (5, 2, 1, 1, 1)
    assert rows_of(profile.cadence(df)) == [(0, 1), (10800, 1), (3600, 1)]


def test_profile_of_nothing(make_readings, spark):
    row = profile.profile(make_readings({"a": [(0, 1.0)]}).filter("false")).first()
    assert (row.rows, row.stations, row.repeated_keys) == (0, 0, 0)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_quantiles_of_extreme_values(spark, few):
    """Infinite, huge, tiny and repeated values need no more passes than others."""
    inf = float("inf")
    values = [inf, inf, -inf, float("nan"), None, 1e300, -1e300, 5e-324, -0.0, 0.0, 1.0, 1.0, 1.0 + 2**-52, 3.0]
    values += [float(n) for n in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    kept = sorted(v for v in values if v is not None and v == v)
    shares = [0.01, 0.05, 0.2, 0.3, 0.5, 0.9, 0.97, 1.0]
    got = {r["probability"]: r["value"] for r in quantiles(df, ["x"], shares, few=few).collect()}
    assert got == {p: kept[max(1, math.ceil(p * len(kept))) - 1] for p in shares}
