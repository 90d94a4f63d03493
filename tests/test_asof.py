import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.config import Chunking
from sensorcast.operators.asof import asof_join


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(4)
    readings, n = [], 0
    for station, size in (("long", 300), ("short", 5), ("bursts", 120), ("silent", 0)):
        at = 0
        for k in range(size):
            at += rnd.choice([1, 2, 2, 30]) if station != "bursts" or k % 40 else 5_000
            readings.append((station, at, float(n := n + 1)))
    last = max(t for _, t, _ in readings)
    asked = [(i, rnd.choice(["long", "long", "short", "bursts", "silent", "unknown"]), rnd.randrange(-50, last + 50)) for i in range(800)]
    asked += [(900 + i, s, t) for i, (s, t, _) in enumerate(readings[::7])]  # at a reading itself
    asked += [(2000, None, 5), (2001, "long", None), (2002, None, None)]
    seconds = lambda name: F.timestamp_seconds(name).alias("timestamp")
    r = spark.createDataFrame(readings, "location_id string, t long, pm25 double").select("location_id", seconds("t"), "pm25")
    a = spark.createDataFrame(asked, "id long, location_id string, t long").select("id", "location_id", seconds("t"))
    return r, a, readings, asked


def wanted(readings, station, at, direction, tolerance):
    own = [(abs(t - at), t, v) for s, t, v in readings if s == station and at is not None]
    if direction != "nearest":
        own = [x for x in own if (x[1] <= at if direction == "before" else x[1] >= at)]
    own = [x for x in own if tolerance is None or x[0] <= tolerance]
    return min(own)[2] if own else None


@pytest.mark.parametrize("chunking", [None, Chunking(), Chunking(rows_per_chunk=20), Chunking(rows_per_chunk=2)])
@pytest.mark.parametrize("direction, tolerance", [("nearest", None), ("nearest", 4), ("before", None), ("after", 10)])
def test_asof(tables, chunking, direction, tolerance):
    r, a, readings, asked = tables
    got = asof_join(a, r, direction, tolerance, chunking=chunking).select("id", "near.pm25")
    want = [(i, wanted(readings, s, t, direction, tolerance)) for i, s, t in asked]
    assert rows_of(got) == sorted(want, key=lambda x: tuple((v is None, str(v)) for v in x))


def test_empty_sides(tables):
    r, a, _, asked = tables
    assert asof_join(a.limit(0), r).count() == 0
    alone = asof_join(a, r.limit(0))
    assert alone.count() == len(asked) and alone.filter("near is not null").count() == 0


def test_bad_arguments(tables):
    r, a, _, _ = tables
    with pytest.raises(ValueError):
        asof_join(a, r, "sideways")
    with pytest.raises(ValueError):
        asof_join(a, r, into="id")


@pytest.mark.parametrize("chunking", [None, Chunking(rows_per_chunk=20)])
def test_work_grows_with_rows(tables, chunking):
    """A frame up to the end of a series is read anew for each of its rows."""
    r, a, _, _ = tables
    plan = asof_join(a, r, chunking=chunking)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
