"""Station attributes as expressions or as a dimension table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.config import STATIONS

DIMENSION_SCHEMA = (
    "location_id string, location_name string, latitude double, longitude double, "
    "location_code double, region_iso string"
)


def station_code(station: Column, codes: Iterable[tuple[str, float]], unknown: float | None) -> Column:
    """Numeric code of a station; ``unknown`` for stations outside the list (None leaves null)."""
    chosen = F
    for name, code in codes:
        chosen = chosen.when(station == F.lit(name), F.lit(float(code)))
    fallback = F.lit(unknown).cast("double")
    return fallback if chosen is F else chosen.otherwise(fallback)


def station_dimension(spark: SparkSession, stations=STATIONS) -> DataFrame:
    return spark.createDataFrame([tuple(s) for s in stations], DIMENSION_SCHEMA)


def attach_dimension(df: DataFrame, dimension: DataFrame, columns: list[str]) -> DataFrame:
    """Add dimension columns by station id. No hint: Spark broadcasts the dimension when its size
    allows and otherwise shuffles, splitting a station that dominates the left side."""
    return df.join(dimension.select("location_id", *columns), "location_id", "left")
