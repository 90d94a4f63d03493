"""A linear model of its own for every station, all fitted in one pass.

A least-squares fit needs no rows, only their variances and covariances, and these add up: one aggregation, most of
it before the shuffle, gives them for all stations at once, so a station with very many rows is no
hot spot. The small systems are solved on the executors, some stations at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.config import STATION
from sensorcast.operators import metrics

MODEL_SCHEMA = f"{STATION} string, rows long, intercept double, coefficients array<double>"


def fit_stations(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(station, rows, intercept, coefficients): ordinary least squares per station over the rows without null or NaN.

    Where features are constant or depend on each other, the solution with the smallest coefficients in units of
    their spread is taken; a station with a single row gets its label as intercept."""
    names = list(features)
    complete = rows.filter(F.col(STATION).isNotNull()).dropna(subset=[*names, label])
    columns = [F.col(n).cast("double") for n in [*names, label]]
    # Centred sums, which stay exact where values are large and their spread is small.
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns)) if (i, j) != (len(names), len(names))]
    sums = complete.groupBy(STATION).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("covariances"),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names)
        for frame in frames:
            out = []
            for station, count, means, covariances in frame.itertuples(index=False):
                whole = np.zeros((size + 1, size + 1))
                for (i, j), value in zip(pairs, covariances):
                    whole[i, j] = whole[j, i] = value
                spread = np.sqrt(np.maximum(np.diag(whole)[:size], 0))
                spread[spread == 0] = 1.0
                scaled = whole[:size, :size] / np.outer(spread, spread)
                slopes = np.linalg.lstsq(scaled, whole[:size, size] / spread, rcond=1e-12)[0] / spread
                means = np.asarray(means)
                out.append((station, count, float(means[size] - slopes @ means[:size]), slopes.tolist()))
            yield pd.DataFrame(out, columns=[STATION, "rows", "intercept", "coefficients"])

    return sums.mapInPandas(solve, MODEL_SCHEMA)


def prediction(features: Sequence[str]) -> Column:
    """What a row's model makes of its features."""
    products = [F.col("coefficients")[i] * F.col(n) for i, n in enumerate(features)]
    return sum(products, F.col("intercept"))


def score_stations(rows: DataFrame, models: DataFrame, features: Sequence[str], into: str = "prediction") -> DataFrame:
    """``rows`` with the prediction of their station's model; null where it has none."""
    fitted = models.select(STATION, "intercept", "coefficients")
    return rows.join(fitted, STATION, "left").withColumn(into, prediction(features)).drop("intercept", "coefficients")


def station_metrics(parts: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Models fitted on each station's training part of a table from ``next_step_table``, and their metrics on the test part."""
    models = fit_stations(parts.filter("part = 'train'"), features, label)
    scored = score_stations(parts.filter("part = 'test'"), models, features).filter(F.col("prediction").isNotNull())
    return models, metrics.regression_metrics(scored, F.col(label), F.col("prediction"), [STATION])
