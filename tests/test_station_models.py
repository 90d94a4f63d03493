import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorcast.plans import station_models


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(3)
    rows = []
    for station in range(40):
        for _ in range(rnd.choice([1, 2, 3, 50])):
            x, y = rnd.gauss(1e6, 1), rnd.gauss(0, 100)
            rows.append((str(station), x, y, 5.0, 3 * x - 2 * y + station + rnd.gauss(0, 0.1)))
    rows += [("gaps", None, 1.0, 5.0, 1.0), ("gaps", 1.0, float("nan"), 5.0, 2.0), ("gaps", 1.0, 1.0, 5.0, None), (None, 1.0, 1.0, 5.0, 1.0)]
    rows += [("huge", float(n), -float(n), 5.0, 2.0 * n) for n in range(5_000)]  # two features that depend on each other
    return spark.createDataFrame(rows, "location_id string, x double, y double, same double, label double"), rows


FEATURES = ["x", "y", "same"]


def test_models_equal_least_squares(table):
    frame, rows = table
    models = {r["location_id"]: r for r in station_models.fit_stations(frame, FEATURES, "label").collect()}
    assert set(models) == {str(n) for n in range(40)} | {"huge"}
    for station, model in models.items():
        own = np.array([r[1:] for r in rows if r[0] == station], float)
        assert model["rows"] == len(own)
        made = model["intercept"] + own[:, :3] @ np.array(model["coefficients"])
        centred = own[:, :3] - own[:, :3].mean(axis=0)
        best = own[:, 3].mean() + centred @ np.linalg.lstsq(centred, own[:, 3] - own[:, 3].mean(), rcond=1e-9)[0]
        assert np.sum((made - own[:, 3]) ** 2) <= np.sum((best - own[:, 3]) ** 2) + 1e-6 * max(1, np.ptp(own[:, 3]) ** 2)
        assert model["coefficients"][2] == 0.0


def test_scores(table):
    frame, rows = table
    models = station_models.fit_stations(frame.filter("location_id <> '3'"), FEATURES, "label")
    scored = station_models.score_stations(frame, models, FEATURES)
    assert scored.count() == len(rows)
    assert scored.filter("prediction is not null").select("location_id").distinct().count() == 40
    worst = scored.filter("location_id = 'huge'").agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert worst < 1e-6


def test_nothing(table):
    frame, _ = table
    assert station_models.fit_stations(frame.limit(0), FEATURES, "label").count() == 0
    assert station_models.fit_stations(frame, [], "label").filter("size(coefficients) = 0").count() == 42


def test_one_job_for_all_stations(table):
    frame, _ = table
    plan = station_models.fit_stations(frame, FEATURES, "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_covar_pop" in plan
