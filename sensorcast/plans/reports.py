"""The tables a dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorcast.config import DISPLAY_ZONE, STATION, TIME
from sensorcast.functions.bands import AQI_BANDS, PM25_BANDS, Band, band_guidance, band_label, band_level
from sensorcast.functions.calendar import display_time
from sensorcast.functions.stations import attach_dimension
from sensorcast.operators import series
from sensorcast.operators.clean import drop_incomplete, keep_last
from sensorcast.schema import FORECAST_DATE, LANDED_AT, REVISION, SCORED_AT, SOURCE_OFFSET

RECENT_COLUMNS = (TIME, "pm25", "pm10", "aqi", "co", "no2", "so2", "o3")


def station_overview(readings: DataFrame, dimension: DataFrame) -> DataFrame:
    """Newest reading of each station with its band and region code."""
    newest = series.latest(readings).withColumn("quality", band_label(F.col("aqi"), AQI_BANDS))
    return attach_dimension(newest, dimension, ["region_iso"])


def region_overlay(regions: DataFrame, overview: DataFrame) -> DataFrame:
    """Every region with the AQI of its station, 0 where there is none."""
    stations = overview.select("region_iso", STATION, "aqi")
    return regions.join(stations, "region_iso", "left").withColumn("aqi", F.coalesce("aqi", F.lit(0.0)))


def colour_ceiling(overview: DataFrame) -> DataFrame:
    """Upper end of the colour scale: the highest AQI, at least 100."""
    return overview.agg(F.greatest(F.lit(100.0), F.max("aqi")).alias("ceiling"))


def last_forecasts(forecasts: DataFrame) -> DataFrame:
    """One forecast per station, instant and horizon, the one that was made last: by time of scoring,
    then by version of the feature row. Where neither is known it is at least always the same one."""
    order = [c for c in (SCORED_AT, REVISION, "batch_id") if c in forecasts.columns]
    return keep_last(forecasts, [*order, "predicted_pm25"], (STATION, TIME, "horizon_hours"))


def last_readings(readings: DataFrame) -> DataFrame:
    """One reading per station and instant, the one that landed last."""
    landed = [c for c in (LANDED_AT, SOURCE_OFFSET) if c in readings.columns]
    return keep_last(readings, [*landed, "pm25"])


def forecast_lookup(newest: DataFrame, forecasts: DataFrame, horizon: int) -> DataFrame:
    """Each station's newest reading with its forecast for one horizon; ``status`` tells whether the
    forecast is there yet."""
    asked, keys = newest.select(STATION, TIME), [STATION, TIME]
    if FORECAST_DATE in forecasts.columns:
        # A folder per date: only those of newest readings are read.
        asked, keys = asked.withColumn(FORECAST_DATE, F.to_date(TIME)), [*keys, FORECAST_DATE]
    due = forecasts.filter(F.col("horizon_hours") == horizon).join(asked, keys, "left_semi")
    wanted = last_forecasts(due).select(STATION, TIME, "predicted_pm25", "forecast_for")
    return newest.join(wanted, [STATION, TIME], "left").withColumn(
        "status", F.when(F.col("predicted_pm25").isNull(), F.lit("waiting")).otherwise(F.lit("ready"))
    )


def find_forecast(forecasts: DataFrame, station: str, instant: Column, horizon: int) -> DataFrame:
    """The last forecast made at ``instant`` for one station and horizon. All tests reach the scan, and
    of stored forecasts only the folder of that date is read."""
    asked = (F.col(STATION) == station) & (F.col(TIME) == instant) & (F.col("horizon_hours") == horizon)
    if FORECAST_DATE in forecasts.columns:
        asked = asked & (F.col(FORECAST_DATE) == F.to_date(instant))
    return last_forecasts(forecasts.filter(asked))


def forecast_vs_actual(forecasts: DataFrame, readings: DataFrame) -> DataFrame:
    """Forecasts whose time has come, with the value measured then and the error."""
    measured = last_readings(readings).select(STATION, F.col(TIME).alias("forecast_for"), F.col("pm25").alias("actual_pm25"))
    return last_forecasts(forecasts).join(measured, [STATION, "forecast_for"]).withColumn(
        "error", F.col("actual_pm25") - F.col("predicted_pm25")
    )


def station_detail(
    readings: DataFrame, forecasts: DataFrame, horizon: int, zone: str = DISPLAY_ZONE
) -> DataFrame:
    """What the detail page of every station shows for one horizon."""
    newest = series.latest_with_change(readings, ["pm25"])
    now = band_guidance(F.col("aqi"), AQI_BANDS)
    then = band_guidance(F.col("predicted_pm25"), PM25_BANDS)
    return (
        forecast_lookup(newest, forecasts, horizon)
        .withColumn("_now", now)
        .withColumn("_then", then)
        .select(
            STATION,
            "location_name",
            TIME,
            "pm25",
            "pm25_delta",
            "pm10",
            "aqi",
            F.col("_now.label").alias("quality"),
            F.col("_now.colour").alias("quality_colour"),
            F.col("_now.advice").alias("quality_advice"),
            "predicted_pm25",
            "forecast_for",
            "status",
            F.col("_then.label").alias("forecast_quality"),
            F.col("_then.colour").alias("forecast_colour"),
            F.col("_then.advice").alias("forecast_advice"),
            display_time(F.col(TIME), zone).alias("reading_time_local"),
            display_time(F.col("forecast_for"), zone).alias("forecast_time_local"),
        )
    )


def station_series(readings: DataFrame) -> DataFrame:
    return series.long_form(readings, ["pm25", "pm10"])


def recent_readings(readings: DataFrame, rows: int = 20) -> DataFrame:
    """The newest rows of each station, numbered from the newest."""
    return series.recent(readings.select(STATION, *RECENT_COLUMNS), rows)


def clean_history(readings: DataFrame) -> DataFrame:
    """Readings with a usable time, in time order."""
    return drop_incomplete(readings, [TIME]).orderBy(TIME, STATION)


def alerts(df: DataFrame, value: str, level: int, bands: tuple[Band, ...] = AQI_BANDS) -> DataFrame:
    """Rows whose value lies in band ``level`` (0 is the lowest) or above. Works on streams too."""
    return (
        df.withColumn("alert_level", band_level(F.col(value), bands))
        .filter(F.col("alert_level") >= level)
        .withColumn("alert_label", band_label(F.col(value), bands))
    )
