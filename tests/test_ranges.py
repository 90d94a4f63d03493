from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorcast.operators.ranges import range_aggregates

START = datetime(2024, 1, 1)
SCHEMA = "id int, location_id string, at string, v double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("timestamp", F.col("at").cast("timestamp")).drop("at")


def expected(rows, since, until):
    found = {}
    for i, station, at, _ in rows:
        inside = []
        if at is not None:
            mine = datetime.fromisoformat(at)
            for _, other, when, v in rows:
                if other == station and when is not None and v is not None:
                    if mine - since <= datetime.fromisoformat(when) <= mine - until:
                        inside.append(v)
        found[i] = (len(inside), sum(inside), min(inside), max(inside)) if inside else (0, None, None, None)
    return found


def measured(df):
    assert df.columns == ["id", "location_id", "v", "timestamp", *[f"range_{n}" for n in ("rows", "sum", "mean", "min", "max")]]
    found = {}
    for r in df.collect():
        assert r["range_mean"] == (r["range_sum"] / r["range_rows"] if r["range_rows"] else None)
        found[r["id"]] = (r["range_rows"], r["range_sum"], r["range_min"], r["range_max"])
    return found


def rows():
    made = []
    for station, step, n in (("a", 37, 200), ("b", 600, 40), (None, 250, 30)):
        for i in range(n):
            made.append((station, (START + timedelta(seconds=step * i - 3000)).isoformat(), None if i % 9 == 4 else float(i % 13)))
    made += [("a", START.isoformat(), 100.0), ("a", START.isoformat(), -100.0), ("a", None, 5.0), ("b", "2024-03-01T00:00:00", 1.0)]
    made.append(("a", "1969-12-31T23:59:59.999999", 2.0))
    return [(i, *r) for i, r in enumerate(made)]


@pytest.mark.parametrize(
    "since, until, slot",
    [(3600, 600, 600), (3600, 600, 3000), (3600, 600, 7), (900, 0, None), (0, -900, 100), (600, -600, 599), (37, 37 - 1, 1)],
)
def test_equals_the_range_of_every_row(spark, since, until, slot):
    since, until = timedelta(seconds=since), timedelta(seconds=until)
    found = range_aggregates(table(spark, rows()), "v", since, until, slot and timedelta(seconds=slot))
    assert measured(found) == expected(rows(), since, until)


def test_empty_table_and_wrong_slots(spark):
    hour = timedelta(hours=1)
    assert range_aggregates(table(spark, []), "v", hour, timedelta(0)).count() == 0
    for slot in (timedelta(0), 2 * hour):
        with pytest.raises(ValueError):
            range_aggregates(table(spark, []), "v", hour, timedelta(0), slot)


def test_no_window_is_wider_than_a_slot_of_readings(spark):
    found = range_aggregates(table(spark, rows()), "v", timedelta(hours=1), timedelta(0), timedelta(minutes=5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slot" in line for line in windows)


def test_readings_of_a_slot_are_sorted_once_for_each_end(spark):
    """Every further sort in a chain holds all rows of the task's slots once more."""
    found = range_aggregates(table(spark, rows()), "v", timedelta(hours=1), timedelta(0), timedelta(minutes=5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_instant" in line]
    assert len(windows) == 2
