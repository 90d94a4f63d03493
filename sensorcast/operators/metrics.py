"""Forecast quality. Everything is computed by distributed aggregates; no rows reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorcast.functions.bands import rating


def error_aggregates(actual: Column, forecast: Column) -> dict[str, Column]:
    """MAE, RMSE, R² and MAPE as aggregate expressions. Rows lacking either side are left out."""
    error = actual - forecast
    known = F.when(error.isNotNull(), actual)
    mse = F.avg(error * error)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(mse),
        "r2": F.lit(1.0) - F.try_divide(mse, F.var_pop(known)),
        "mape": F.avg(F.abs(error / F.nullif(known, F.lit(0.0)))),
    }


def regression_metrics(df: DataFrame, actual: Column, forecast: Column, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R² and MAPE over rows where both sides are known, and how many those are."""
    pairs = df.select(*by, actual.alias("_actual"), forecast.alias("_forecast")).dropna()
    errors = error_aggregates(F.col("_actual"), F.col("_forecast"))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[e.alias(name) for name, e in errors.items()]
    )


def with_rating(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("rating", rating(F.col("r2")))


def confusion(df: DataFrame, actual_band: Column, forecast_band: Column) -> DataFrame:
    """Row counts per pair of actual and forecast band."""
    return (
        df.select(actual_band.alias("actual_band"), forecast_band.alias("forecast_band"))
        .dropna()
        .groupBy("actual_band", "forecast_band")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def band_scores(confused: DataFrame) -> DataFrame:
    """Precision, recall and F1 per band and the overall accuracy, from a confusion table.

    Each cell counts once for the band it was and once for the band it was forecast as, so one
    aggregate replaces a full join of row and column totals.
    """
    hit = F.when(F.col("actual_band") == F.col("forecast_band"), F.col("rows")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    roles = F.array(
        F.struct(
            F.col("actual_band").alias("band"), F.col("rows").alias("actual"),
            none.alias("forecast"), hit.cast("long").alias("hits"),
        ),
        F.struct(
            F.col("forecast_band").alias("band"), none.alias("actual"),
            F.col("rows").alias("forecast"), none.alias("hits"),
        ),
    )
    totals = confused.select(F.inline(roles)).groupBy("band").agg(
        F.sum("actual").alias("actual_rows"),
        F.sum("forecast").alias("forecast_rows"),
        F.sum("hits").alias("hits"),
    )
    # One row per band is left here, so a window over all of them is small.
    everything = Window.partitionBy()
    accuracy = F.sum("hits").over(everything) / F.sum("actual_rows").over(everything)
    precision = F.try_divide("hits", "forecast_rows")
    recall = F.try_divide("hits", "actual_rows")
    f1 = F.try_divide(F.lit(2) * F.col("hits"), F.col("actual_rows") + F.col("forecast_rows"))
    return totals.select(
        "band", "actual_rows", "forecast_rows", "hits",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        accuracy.alias("accuracy"),
    )
