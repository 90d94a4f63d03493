"""Quantiles per group against sorting in Python."""

import math
import struct
from decimal import Decimal

from pyspark.sql import functions as F

from sensorcast.operators import clean
from sensorcast.operators.quantiles import _order, grouped_quantiles

INF = float("inf")
ODD = [
    0.0, -0.0, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2), 8.0, math.nextafter(8.0, 0), 5e-324, -5e-324,
    2.2250738585072014e-308, math.nextafter(2.2250738585072014e-308, 0), 1.7976931348623157e308, -1.7976931348623157e308,
    INF, -INF, 0.1, -0.1, 1e-300, 1e300, 3.0, math.nextafter(2.0**40, 0), 2.0**40,
]


def expected(rows, probabilities):
    groups = {}
    for key, value in rows:
        if value is not None and not math.isnan(value):
            groups.setdefault(key, []).append(value)
    found = set()
    for key, values in groups.items():
        for p in probabilities:
            rank = max(1, math.ceil(Decimal(repr(p)) * len(values)))
            found.add((key, p, sorted(values)[rank - 1]))
    return found


def measured(spark, rows, probabilities):
    df = spark.createDataFrame(rows, "k string, v double")
    found = grouped_quantiles(df, ["k"], ["v"], probabilities)
    assert found.columns == ["k", "measure", "probability", "value"]
    return {(r["k"], r["probability"], r["value"]) for r in found.collect()}


def test_order_is_the_order_of_the_bits(spark):
    df = spark.createDataFrame([(v,) for v in ODD], "v double").select("v", _order(F.col("v")).alias("o"))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["o"] == (-bits if r["v"] < 0 else bits), r["v"]


def test_groups_of_any_values(spark):
    rows = [("odd", v) for v in ODD] + [("odd", float("nan")), ("odd", None)]
    rows += [("ties", 7.0)] * 50 + [("ties", 7.5)] * 50 + [("one", -3.25), (None, 4.0), (None, 5.0), ("none", None)]
    rows += [("near", 100.0 + i * 2.0**-46) for i in range(300)] + [("even", float(i)) for i in range(60)]
    probabilities = [0.0, 0.05, 0.5, 0.95, 1.0]
    assert measured(spark, rows, probabilities) == expected(rows, probabilities)


def test_empty_table(spark):
    assert measured(spark, [], [0.5]) == set()


def test_keys_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None)], "`_cell` string, value double, measure double")
    found = grouped_quantiles(df, ["_cell"], ["value", "measure"], [0.5]).collect()
    assert {tuple(r) for r in found} == {("a", "value", 0.5, 1.0), ("a", "measure", 0.5, 2.0)}


def test_outliers_of_their_own_station(spark, make_readings):
    rows = make_readings({"low": [(h, float(h)) for h in range(20)], "high": [(h, 1000.0 + h) for h in range(20)]})
    bounds = clean.quantile_bounds(rows, ["pm25"], 0.1, 0.9, ["location_id"])
    later = make_readings({"low": [(30, 500.0), (31, 5.0)], "high": [(30, 1010.0), (31, float("nan"))], "new": [(30, 1.0)]})
    flagged = clean.flag_outliers(later, bounds, ["pm25", "co"])
    assert flagged.columns == [*later.columns, "outliers"]
    found = {(r["location_id"], r["pm25"] == r["pm25"], r["outliers"]) for r in flagged.collect()}
    assert found == {("low", True, "pm25"), ("low", True, ""), ("high", True, ""), ("high", False, "pm25"), ("new", True, "")}
