"""The checked queries as SQL, written against the test tables."""

from __future__ import annotations

from catalog.tables import HOURLY_SQL, READINGS_SQL
from sensorcast.config import HORIZONS, MEASURES
from sensorcast.functions import bands

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def _rounded(columns, digits=6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _case(value: str, table) -> str:
    whens = " ".join(f"WHEN {value} <= {b.upper} THEN '{b.label}'" for b in table[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{table[-1].label}' END"


def _attribute(value: str, table, name: str) -> str:
    whens = " ".join(f"WHEN {value} <= {b.upper} THEN '{getattr(b, name)}'" for b in table[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{getattr(table[-1], name)}' END"


READING_LIST = "location_id, location_name, latitude, longitude, \"timestamp\", " + _rounded(MEASURES)
ROUNDED_MEASURES = _rounded(MEASURES)
CODE = "CASE location_id WHEN 'click' THEN 0.0 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE 3.0 END::DOUBLE"
DAY_FRACTION = "fmod(floor(epoch(\"timestamp\")) / 86400.0 + 4, 7)"


def _features(source: str) -> str:
    return f"""
shifted AS (
  SELECT *,
    lag(pm25, 1) OVER w AS pm25_lag1, lag(pm25, 3) OVER w AS pm25_lag3,
    avg(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm25_mean3,
    lead(pm25, 1) OVER w AS target_pm25
  FROM {source} WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp"))
SELECT location_id, "timestamp", {_rounded(MEASURES, 9)}, {_rounded(["pm25_lag1", "pm25_lag3", "pm25_mean3"], 9)},
  hour("timestamp")::DOUBLE AS hour, round({DAY_FRACTION}, 9) AS day_of_week, {CODE} AS location_code,
  round(target_pm25, 9) AS target_pm25
FROM shifted WHERE pm25_lag3 IS NOT NULL AND target_pm25 IS NOT NULL"""


ORACLES["features_basic"] = _with(READINGS_SQL, _features("readings"))
ORACLES["features_split_stations"] = ORACLES["features_basic"]
ORACLES["features_many_stations"] = _with(
    READINGS_SQL.replace("SELECT event_type AS location_id", "SELECT CAST(user_id AS VARCHAR) AS location_id"),
    _features("readings"),
)

_VECTOR = [*MEASURES, "pm25_lag1", "pm25_lag3", "pm25_mean3"]
ORACLES["vector_assembly"] = _with(READINGS_SQL) + f""",
shifted AS (
  SELECT *, lag(pm25, 1) OVER w AS pm25_lag1, lag(pm25, 3) OVER w AS pm25_lag3,
    avg(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm25_mean3
  FROM readings WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp"))
SELECT location_id, "timestamp", {", ".join(f"round({c}, 9) AS v_{c}" for c in _VECTOR)},
  hour("timestamp")::DOUBLE AS v_hour, round({DAY_FRACTION}, 9) AS v_day_of_week, {CODE} AS v_location_code
FROM shifted WHERE pm25_lag3 IS NOT NULL"""

_FLAGS = ", ".join(
    f"(target_h{h} IS NOT NULL AND series_rank {test} (series_rows - {h}) * 0.8::DOUBLE) AS {name}_h{h}"
    for name, test in (("train", "<="), ("test", ">"))
    for h in HORIZONS
)
ORACLES["training_rows"] = _with(READINGS_SQL) + f""",
shifted AS (
  SELECT *, lag(pm25, 3) OVER w AS pm25_lag3,
    avg(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm25_mean3,
    {", ".join(f"lead(pm25, {h}) OVER w AS target_h{h}" for h in HORIZONS)}
  FROM readings WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp")),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY "timestamp") AS series_rank,
    count(*) OVER (PARTITION BY location_id) AS series_rows
  FROM shifted WHERE pm25_lag3 IS NOT NULL)
SELECT location_id, "timestamp", {_rounded(["pm25_mean3", *[f"target_h{h}" for h in HORIZONS]])},
  series_rank, series_rows, {_FLAGS}
FROM ranked"""
ORACLES["training_rows_split_stations"] = ORACLES["training_rows"]

ORACLES["time_aware_lags"] = _with(READINGS_SQL, HOURLY_SQL) + f"""
SELECT h.location_id, h."timestamp", round(h.pm25, 9) AS pm25, round(l1.pm25, 9) AS pm25_lag1,
  round(l3.pm25, 9) AS pm25_lag3,
  (SELECT round(avg(p.pm25), 9) FROM hourly p WHERE p.location_id = h.location_id
     AND p."timestamp" BETWEEN h."timestamp" - INTERVAL 3 HOUR AND h."timestamp" - INTERVAL 1 HOUR) AS pm25_mean3,
  {", ".join(f"round(t{h}.pm25, 9) AS target_h{h}" for h in HORIZONS)}
FROM hourly h
LEFT JOIN hourly l1 ON l1.location_id = h.location_id AND l1."timestamp" = h."timestamp" - INTERVAL 1 HOUR
LEFT JOIN hourly l3 ON l3.location_id = h.location_id AND l3."timestamp" = h."timestamp" - INTERVAL 3 HOUR
""" + "\n".join(
    f"""LEFT JOIN hourly t{h} ON t{h}.location_id = h.location_id AND t{h}."timestamp" = h."timestamp" + INTERVAL {h} HOUR"""
    for h in HORIZONS
)
ORACLES["time_aware_lags_split_stations"] = ORACLES["time_aware_lags"]

_HOUR_LABELS = [f"target_h{h}" for h in HORIZONS]
_HOUR_FLAGS = ", ".join(
    f"(target_h{h} IS NOT NULL AND count(target_h{h}) OVER upto {test} count(target_h{h}) OVER station * 0.8::DOUBLE) AS {name}_h{h}"
    for name, test in (("train", "<="), ("test", ">"))
    for h in HORIZONS
)
ORACLES["training_rows_hours"] = f"""
SELECT location_id, "timestamp", pm25_mean3, {", ".join(_HOUR_LABELS)},
  row_number() OVER (PARTITION BY location_id ORDER BY "timestamp") AS series_rank,
  count(*) OVER station AS series_rows, {_HOUR_FLAGS}
FROM ({ORACLES["time_aware_lags"]}) lags
WHERE pm25_lag1 IS NOT NULL AND pm25_lag3 IS NOT NULL AND pm25_mean3 IS NOT NULL
WINDOW station AS (PARTITION BY location_id),
  upto AS (PARTITION BY location_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)"""
ORACLES["training_rows_hours_split_stations"] = ORACLES["training_rows_hours"]

ORACLES["station_encode"] = _with(READINGS_SQL) + f"""
SELECT location_id, {CODE} AS location_code, count(*) AS rows FROM readings GROUP BY ALL"""

ORACLES["calendar_fields"] = _with(READINGS_SQL) + f"""
SELECT event_id, hour("timestamp")::DOUBLE AS hour, round({DAY_FRACTION}, 9) AS day_of_week_fraction,
  dayofweek("timestamp")::INTEGER AS day_of_week, month("timestamp")::INTEGER AS month,
  day("timestamp")::INTEGER AS day_of_month,
  strftime("timestamp" + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS local_time
FROM readings"""

_NUMBERED = """numbered AS (
  SELECT location_id, "timestamp", pm25, row_number() OVER (PARTITION BY location_id ORDER BY "timestamp") AS n
  FROM readings)"""
_PAIRS = f"""{_NUMBERED},
pairs AS (
  SELECT a.location_id, a."timestamp", a.pm25, h.h::INTEGER AS horizon_hours, b.pm25 AS target
  FROM numbered a CROSS JOIN range(1, 25) h(h)
  LEFT JOIN numbered b ON b.location_id = a.location_id AND b.n = a.n + h.h)"""

ORACLES["horizon_labels"] = _with(READINGS_SQL, _PAIRS) + """
SELECT location_id, "timestamp", round(pm25, 6) AS pm25, horizon_hours, round(target, 6) AS target FROM pairs"""
ORACLES["horizon_labels_split_stations"] = ORACLES["horizon_labels"]

_RANKED = """ranked AS (
  SELECT location_id, "timestamp", pm25,
    row_number() OVER (PARTITION BY location_id ORDER BY "timestamp") AS series_rank,
    count(*) OVER (PARTITION BY location_id) AS series_rows
  FROM readings)"""
ORACLES["chrono_split"] = _with(READINGS_SQL, _RANKED) + """
SELECT location_id, "timestamp", round(pm25, 6) AS pm25, series_rank, series_rows,
  CASE WHEN series_rank <= series_rows * 0.8::DOUBLE THEN 'train' ELSE 'test' END AS part
FROM ranked"""
ORACLES["chrono_split_split_stations"] = ORACLES["chrono_split"]
ORACLES["three_way_split"] = _with(READINGS_SQL, _RANKED) + """
SELECT location_id, "timestamp", round(pm25, 6) AS pm25, series_rank, series_rows,
  CASE WHEN series_rank <= series_rows * 0.6::DOUBLE - 24 THEN 'train'
       WHEN series_rank <= series_rows * 0.6::DOUBLE THEN NULL
       WHEN series_rank <= series_rows * 0.8::DOUBLE - 24 THEN 'validation'
       WHEN series_rank <= series_rows * 0.8::DOUBLE THEN NULL
       ELSE 'test' END AS part
FROM ranked"""

ORACLES["hourly_resample"] = _with(READINGS_SQL, HOURLY_SQL) + f"""
SELECT location_id, location_name, "timestamp", {_rounded(MEASURES, 9)}, readings FROM hourly"""

ORACLES["sensor_clean"] = """
SELECT event_id, date_trunc('second', ts) AS "timestamp",
  CASE WHEN event_id % 13 <> 0 THEN round(value, 2) END AS pm25, user_id::DOUBLE AS no2
FROM events"""
ORACLES["sensor_csv_scan"] = """
SELECT date_trunc('second', ts) AS "timestamp",
  CASE WHEN event_id % 13 <> 0 THEN round(value, 2) END AS pm25, user_id::DOUBLE AS no2, event_id::DOUBLE AS co
FROM events"""
ORACLES["drop_missing"] = """
SELECT event_id, date_trunc('second', ts) AS "timestamp", round(value, 2) AS pm25
FROM events WHERE event_id % 13 <> 0"""

ORACLES["csv_roundtrip"] = _with(READINGS_SQL) + f" SELECT {READING_LIST} FROM readings"
ORACLES["json_roundtrip"] = ORACLES["csv_roundtrip"]
ORACLES["stream_ingest"] = ORACLES["csv_roundtrip"]
ORACLES["time_ordered_history"] = ORACLES["csv_roundtrip"]

ORACLES["message_quarantine"] = """
SELECT CASE WHEN event_id % 13 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN 'no station'
            WHEN event_id % 7 = 0 THEN 'unreadable time' WHEN event_id % 5 = 0 THEN 'no time'
            ELSE 'accepted' END AS outcome, count(*) AS messages
FROM events GROUP BY 1"""
ORACLES["stream_rejects"] = ORACLES["message_quarantine"]
ORACLES["stream_late_readings"] = """
WITH m AS (
  SELECT CASE WHEN event_id % 13 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN 'no station'
              WHEN event_id % 7 = 0 THEN 'unreadable time' WHEN event_id % 5 = 0 THEN 'no time'
              ELSE 'accepted' END AS outcome, event_id
  FROM events)
SELECT outcome, CAST(sum(CASE WHEN outcome <> 'accepted' AND event_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS messages
FROM m GROUP BY outcome"""

_READ = ["location_id", '"timestamp"', *MEASURES]
ORACLES["landed_compacted"] = _with(READINGS_SQL) + """,
m AS (
  SELECT *, CASE WHEN event_id % 13 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN 'no station'
                 WHEN event_id % 7 = 0 THEN 'unreadable time' WHEN event_id % 5 = 0 THEN 'no time'
                 ELSE 'accepted' END AS outcome
  FROM readings)
SELECT outcome, """ + ", ".join(
    f"CASE WHEN outcome = 'accepted' THEN {f'round({c}, 6)' if c in MEASURES else c} END AS {c}" for c in _READ
) + " FROM m"

ORACLES["payload_flatten"] = _with(READINGS_SQL, HOURLY_SQL) + f"""
SELECT location_id, "timestamp", {_rounded(MEASURES, 9)} FROM hourly"""

ORACLES["range_check"] = _with(READINGS_SQL) + """
SELECT event_id,
  CASE WHEN pm25 BETWEEN 1 AND 250 THEN round(pm25, 6) END AS pm25,
  CASE WHEN pm10 <= 300 THEN round(pm10, 6) END AS pm10,
  CASE WHEN co >= 5 THEN round(co, 6) END AS co,
  concat_ws(',', CASE WHEN pm25 < 1 OR pm25 > 250 THEN 'pm25' END, CASE WHEN pm10 > 300 THEN 'pm10' END,
            CASE WHEN co < 5 THEN 'co' END) AS out_of_range
FROM readings"""

ORACLES["outlier_bounds"] = _with(READINGS_SQL) + "\nUNION ALL\n".join(
    f" SELECT '{m}' AS measure, round(quantile_disc({m}, 0.01), 6) AS low, round(quantile_disc({m}, 0.99), 6) AS high FROM readings"
    for m in MEASURES
)

_DISTURBED = READINGS_SQL.replace("SELECT event_type AS location_id", "SELECT CAST(user_id AS VARCHAR) AS location_id") + """,
disturbed AS (
  SELECT event_id, location_id, co, 1.0::DOUBLE - pm25 AS so2,
    CASE event_id % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL
      ELSE pm25 END AS pm25
  FROM readings)"""


def _station_bounds(measures, low, high) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT location_id, '{m}' AS measure, quantile_disc({m}, {low}) AS low, quantile_disc({m}, {high}) AS high
FROM disturbed WHERE {m} IS NOT NULL AND NOT isnan({m}) GROUP BY 1"""
        for m in measures
    )


ORACLES["outlier_bounds_per_station"] = _with(_DISTURBED) + f"""
SELECT location_id, measure, {_rounded(["low", "high"])} FROM ({_station_bounds(["pm25", "co", "so2"], 0.05, 0.95)})"""

ORACLES["outliers_per_station"] = _with(_DISTURBED, f"bounds AS ({_station_bounds(['pm25', 'so2'], 0.25, 0.75)})") + """
SELECT d.event_id, d.location_id, concat_ws(',',
    CASE WHEN isnan(d.pm25) OR d.pm25 < p.low OR d.pm25 > p.high THEN 'pm25' END,
    CASE WHEN isnan(d.so2) OR d.so2 < s.low OR d.so2 > s.high THEN 'so2' END) AS outliers
FROM disturbed d
LEFT JOIN bounds p ON p.location_id = d.location_id AND p.measure = 'pm25'
LEFT JOIN bounds s ON s.location_id = d.location_id AND s.measure = 'so2'"""

ORACLES["dedupe_last"] = _with(READINGS_SQL) + f"""
SELECT location_id, location_name, latitude, longitude, "timestamp", round(pm25 + 1, 6) AS pm25,
  {_rounded(MEASURES[1:])}, 2::INTEGER AS ingest_seq
FROM readings"""

ORACLES["dataset_profile"] = _with(READINGS_SQL) + """
SELECT count(*) AS rows, count(DISTINCT location_id) AS stations,
  count(*) - count(DISTINCT (location_id, "timestamp")) AS repeated_keys,
  min("timestamp") AS first_time, max("timestamp") AS last_time,
  """ + ",\n  ".join(f"count(*) - count({m}) AS {m}_null" for m in MEASURES) + """,
  count(*) FILTER (pm25 < 1 OR pm25 > 250) AS pm25_out, count(*) FILTER (pm10 > 300) AS pm10_out,
  count(*) FILTER (co < 5) AS co_out
FROM readings"""

ORACLES["cadence_histogram"] = _with(READINGS_SQL, HOURLY_SQL) + """
SELECT step_seconds, count(*) AS readings FROM (
  SELECT epoch("timestamp")::BIGINT - lag(epoch("timestamp")::BIGINT) OVER (PARTITION BY location_id ORDER BY "timestamp") AS step_seconds
  FROM hourly) WHERE step_seconds IS NOT NULL GROUP BY 1"""

ORACLES["station_counts"] = "SELECT event_type AS location_id, count(*) AS rows FROM events GROUP BY 1"

_QUALITY = """count(*) AS rows, round(avg(abs(target - pm25)), 6) AS mae, round(sqrt(avg((target - pm25) ** 2)), 6) AS rmse,
  1 - avg((target - pm25) ** 2) / var_pop(target) AS r2_exact,
  round(avg(abs((target - pm25) / nullif(target, 0))), 6) AS mape"""
ORACLES["persistence_metrics"] = _with(READINGS_SQL, _PAIRS) + f""",
quality AS (SELECT horizon_hours, {_QUALITY} FROM pairs WHERE target IS NOT NULL GROUP BY 1)
SELECT horizon_hours, rows, mae, rmse, round(r2_exact, 6) AS r2, mape,
  CASE {' '.join(f"WHEN r2_exact >= {low} THEN '{label}'" for low, label in bands.RATINGS)}
       ELSE '{bands.LOWEST_RATING}' END AS rating
FROM quality"""

ORACLES["band_histogram"] = f"""
SELECT {_case("value", bands.AQI_BANDS)} AS aqi_band, {_case("value", bands.PM25_BANDS)} AS pm25_band,
  {_case("value", bands.SIMPLE_AQI_BANDS)} AS simple_band, count(*) AS rows
FROM events GROUP BY 1, 2, 3"""

_CONFUSED = f"""confused AS (
  SELECT {_case("target", bands.PM25_BANDS)} AS actual_band, {_case("pm25", bands.PM25_BANDS)} AS forecast_band,
    count(*) AS rows
  FROM (SELECT pm25, lead(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp") AS target FROM readings)
  WHERE target IS NOT NULL GROUP BY 1, 2)"""
ORACLES["band_confusion"] = _with(READINGS_SQL, _CONFUSED) + " SELECT * FROM confused"
ORACLES["band_scores"] = _with(READINGS_SQL, _CONFUSED) + """,
actual AS (SELECT actual_band AS band, sum(rows)::BIGINT AS actual_rows FROM confused GROUP BY 1),
forecast AS (SELECT forecast_band AS band, sum(rows)::BIGINT AS forecast_rows FROM confused GROUP BY 1),
hit AS (SELECT actual_band AS band, rows AS hits FROM confused WHERE actual_band = forecast_band),
total AS (SELECT sum(rows) AS n FROM confused), right_ones AS (SELECT sum(hits) AS n FROM hit),
joined AS (
  SELECT band, coalesce(actual_rows, 0) AS actual_rows, coalesce(forecast_rows, 0) AS forecast_rows, coalesce(hits, 0) AS hits
  FROM actual FULL JOIN forecast USING (band) LEFT JOIN hit USING (band))
SELECT band, actual_rows, forecast_rows, hits, round(hits / nullif(forecast_rows, 0)::DOUBLE, 6) AS precision,
  round(hits / nullif(actual_rows, 0)::DOUBLE, 6) AS recall,
  round(2 * hits / (actual_rows + forecast_rows)::DOUBLE, 6) AS f1,
  round((SELECT n FROM right_ones)::DOUBLE / (SELECT n FROM total), 6) AS accuracy
FROM joined"""

_FANOUT = """forecasts AS (
  SELECT r.location_id, r.location_name, r."timestamp", r.pm25, r.aqi, r.pm25 AS predicted_pm25,
    h.h::INTEGER AS horizon_hours, r."timestamp" + to_hours(h.h) AS forecast_for
  FROM {source} r CROSS JOIN range(1, 25) h(h))"""
_FORECAST_LIST = (
    "location_id, location_name, \"timestamp\", round(pm25, 6) AS pm25, round(aqi, 6) AS aqi, "
    "round(predicted_pm25, 6) AS predicted_pm25, horizon_hours, forecast_for"
)
ORACLES["forecast_fanout"] = _with(READINGS_SQL, _FANOUT.format(source="readings")) + f"""
SELECT {_FORECAST_LIST} FROM forecasts"""

ORACLES["forecast_vs_actual"] = _with(READINGS_SQL, HOURLY_SQL, _FANOUT.format(source="hourly")) + """
SELECT f.location_id, f.location_name, f."timestamp", round(f.pm25, 9) AS pm25, round(f.aqi, 9) AS aqi,
  round(f.predicted_pm25, 9) AS predicted_pm25, f.horizon_hours, f.forecast_for,
  round(a.pm25, 9) AS actual_pm25, round(a.pm25 - f.predicted_pm25, 9) AS error
FROM forecasts f JOIN hourly a ON a.location_id = f.location_id AND a."timestamp" = f.forecast_for"""

ORACLES["find_forecast"] = _with(READINGS_SQL, _FANOUT.format(source="readings")) + f"""
SELECT {_FORECAST_LIST} FROM forecasts WHERE location_id = 'click' AND horizon_hours = 12
  AND "timestamp" = (SELECT min("timestamp") FROM readings WHERE location_id = 'click')"""
ORACLES["station_filter"] = _with(READINGS_SQL) + f"""
SELECT {READING_LIST} FROM readings WHERE location_id = 'purchase'"""

_LATEST = """latest AS (
  SELECT *, lag(pm25) OVER w AS before25, lag(pm10) OVER w AS before10,
    row_number() OVER (PARTITION BY location_id ORDER BY "timestamp" DESC) AS n
  FROM readings WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp"))"""
ORACLES["latest_per_station"] = _with(READINGS_SQL, _LATEST) + f" SELECT {READING_LIST} FROM latest WHERE n = 1"
ORACLES["latest_with_delta"] = _with(READINGS_SQL, _LATEST) + f"""
SELECT {READING_LIST}, round(pm25 - coalesce(before25, pm25), 6) AS pm25_delta,
  round(pm10 - coalesce(before10, pm10), 6) AS pm10_delta
FROM latest WHERE n = 1"""

ORACLES["storage_contents"] = _with(READINGS_SQL) + """
SELECT format, count(*) AS rows, round(avg(pm25), 6) AS mean
FROM readings, (VALUES ('csv'), ('parquet'), ('orc'), ('json')) formats(format) GROUP BY format"""

ORACLES["nearest_reading"] = _with(READINGS_SQL) + f""",
near AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY
    abs(epoch_us("timestamp") - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), "timestamp") AS n
  FROM readings)
SELECT {READING_LIST} FROM near WHERE n = 1"""

ORACLES["forecast_lookup"] = _with(READINGS_SQL, _LATEST) + """
SELECT location_id, "timestamp", round(pm25, 6) AS pm25,
  CASE WHEN location_id <> 'view' THEN round(pm25, 6) END AS predicted_pm25,
  CASE WHEN location_id <> 'view' THEN "timestamp" + INTERVAL 6 HOUR END AS forecast_for,
  CASE WHEN location_id <> 'view' THEN 'ready' ELSE 'waiting' END AS status
FROM latest WHERE n = 1"""

_REGION = "CASE location_id WHEN 'click' THEN 'VIETNAM' WHEN 'error' THEN 'CHINA' WHEN 'purchase' THEN 'JAPAN' WHEN 'signup' THEN 'INDIA' END"
ORACLES["station_overview"] = _with(READINGS_SQL, _LATEST) + f"""
SELECT {READING_LIST}, {_case("aqi", bands.AQI_BANDS)} AS quality, {_REGION} AS region_iso FROM latest WHERE n = 1"""
ORACLES["region_overlay"] = _with(READINGS_SQL, _LATEST) + f""",
overview AS (SELECT location_id, aqi, {_REGION} AS region_iso FROM latest WHERE n = 1)
SELECT n_name AS region_iso, location_id, round(coalesce(aqi, 0), 6) AS aqi
FROM nation LEFT JOIN overview ON region_iso = n_name"""
ORACLES["colour_ceiling"] = _with(READINGS_SQL, _LATEST) + """
SELECT round(greatest(100.0::DOUBLE, max(aqi)), 6) AS ceiling FROM latest WHERE n = 1"""

ORACLES["station_detail"] = _with(READINGS_SQL, _LATEST) + f""",
shown AS (
  SELECT *, CASE WHEN location_id <> 'view' THEN pm25 END AS predicted,
    CASE WHEN location_id <> 'view' THEN "timestamp" + INTERVAL 6 HOUR END AS due
  FROM latest WHERE n = 1)
SELECT location_id, location_name, "timestamp", round(pm25, 6) AS pm25,
  round(pm25 - coalesce(before25, pm25), 6) AS pm25_delta, round(pm10, 6) AS pm10, round(aqi, 6) AS aqi,
  {_case("aqi", bands.AQI_BANDS)} AS quality,
  {_attribute("aqi", bands.AQI_BANDS, "colour")} AS quality_colour,
  {_attribute("aqi", bands.AQI_BANDS, "advice")} AS quality_advice,
  round(predicted, 6) AS predicted_pm25, due AS forecast_for,
  CASE WHEN predicted IS NULL THEN 'waiting' ELSE 'ready' END AS status,
  {_case("predicted", bands.PM25_BANDS)} AS forecast_quality,
  {_attribute("predicted", bands.PM25_BANDS, "colour")} AS forecast_colour,
  {_attribute("predicted", bands.PM25_BANDS, "advice")} AS forecast_advice,
  strftime("timestamp" + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS reading_time_local,
  strftime(due + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS forecast_time_local
FROM shown"""

ORACLES["station_series"] = _with(READINGS_SQL) + """
SELECT location_id, "timestamp", 'pm25' AS measure, round(pm25, 6) AS value FROM readings
UNION ALL SELECT location_id, "timestamp", 'pm10', round(pm10, 6) FROM readings"""

ORACLES["recent_readings"] = _with(READINGS_SQL, _LATEST) + f"""
SELECT location_id, "timestamp", {ROUNDED_MEASURES}, n::INTEGER AS recency FROM latest WHERE n <= 20"""

ORACLES["recent_days"] = _with(READINGS_SQL) + f"""
SELECT {READING_LIST} FROM (SELECT *, max("timestamp") OVER (PARTITION BY location_id) AS newest FROM readings)
WHERE "timestamp" > newest - INTERVAL 7 DAY"""

ORACLES["station_list"] = _with(READINGS_SQL) + " SELECT DISTINCT location_id, location_name FROM readings"

ORACLES["alerts"] = _with(READINGS_SQL) + f"""
SELECT event_id, location_id, "timestamp", round(aqi, 6) AS aqi,
  (CASE WHEN aqi <= 100 THEN 4 ELSE 5 END)::INTEGER AS alert_level, {_case("aqi", bands.AQI_BANDS)} AS alert_label
FROM readings WHERE aqi > 80"""

_LAGGED = """lagged AS (
  SELECT h.*, l1.pm25 AS pm25_lag1, l3.pm25 AS pm25_lag3,
    (SELECT avg(p.pm25) FROM hourly p WHERE p.location_id = h.location_id
       AND p."timestamp" BETWEEN h."timestamp" - INTERVAL 3 HOUR AND h."timestamp" - INTERVAL 1 HOUR) AS pm25_mean3
  FROM hourly h
  JOIN hourly l1 ON l1.location_id = h.location_id AND l1."timestamp" = h."timestamp" - INTERVAL 1 HOUR
  JOIN hourly l3 ON l3.location_id = h.location_id AND l3."timestamp" = h."timestamp" - INTERVAL 3 HOUR)"""
ORACLES["stream_features"] = _with(READINGS_SQL, HOURLY_SQL, _LAGGED) + f"""
SELECT location_id, location_name, "timestamp", {_rounded(_VECTOR, 9)},
  hour("timestamp")::DOUBLE AS hour, round({DAY_FRACTION}, 9) AS day_of_week, {CODE} AS location_code
FROM lagged"""

ORACLES["stream_alerts"] = _with(READINGS_SQL, HOURLY_SQL) + f"""
SELECT location_id, "timestamp", round(aqi, 9) AS aqi, {_case("aqi", bands.AQI_BANDS)} AS alert_label
FROM hourly WHERE aqi > 60"""


# Nearest hours by SQL's own as-of joins, one in each direction.
_ASKED = """asked AS (
  SELECT event_id, event_type AS location_id,
    CASE WHEN event_id % 10 = 0 THEN date_trunc('hour', ts) + INTERVAL 30 MINUTE ELSE ts END AS "timestamp" FROM events)"""
_BOTH_SIDES = """sides AS (
  SELECT a.*, b."timestamp" AS t1, b.pm25 AS v1, c."timestamp" AS t2, c.pm25 AS v2
  FROM asked a
  ASOF LEFT JOIN hourly b ON a.location_id = b.location_id AND a."timestamp" >= b."timestamp"
  ASOF LEFT JOIN hourly c ON a.location_id = c.location_id AND a."timestamp" <= c."timestamp"),
chosen AS (
  SELECT *, t2 IS NULL OR epoch_us("timestamp") - epoch_us(t1) <= epoch_us(t2) - epoch_us("timestamp") AS earlier FROM sides)"""
ORACLES["nearest_readings"] = _with(READINGS_SQL, HOURLY_SQL, _ASKED, _BOTH_SIDES) + """
SELECT event_id, location_id, "timestamp", CASE WHEN earlier THEN t1 ELSE t2 END AS near_timestamp,
  round(CASE WHEN earlier THEN v1 ELSE v2 END, 9) AS near_pm25 FROM chosen"""
ORACLES["nearest_readings_split_stations"] = ORACLES["nearest_readings"]
ORACLES["readings_before"] = _with(READINGS_SQL, HOURLY_SQL, _ASKED, _BOTH_SIDES) + """
SELECT event_id, location_id, "timestamp",
  CASE WHEN epoch_us("timestamp") - epoch_us(t1) <= 1200000000 THEN t1 END AS near_timestamp,
  CASE WHEN epoch_us("timestamp") - epoch_us(t1) <= 1200000000 THEN round(v1, 9) END AS near_pm25 FROM sides"""

_AFTER_A_GAP = READINGS_SQL.replace(
    'ts AS "timestamp"',
    """ts + CASE WHEN event_type = 'view' AND ts >= TIMESTAMP '2024-01-20' THEN INTERVAL 60 DAY ELSE INTERVAL 0 DAY END AS "timestamp\"""",
)
ORACLES["stream_features_rows"] = _with(_AFTER_A_GAP) + f""",
shifted AS (
  SELECT *, lag(pm25, 1) OVER w AS pm25_lag1, lag(pm25, 3) OVER w AS pm25_lag3,
    avg(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pm25_mean3
  FROM readings WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp"))
SELECT location_id, location_name, "timestamp", {_rounded(_VECTOR, 9)},
  hour("timestamp")::DOUBLE AS hour, round({DAY_FRACTION}, 9) AS day_of_week, {CODE} AS location_code
FROM shifted WHERE pm25_lag3 IS NOT NULL"""

ORACLES["find_forecast_repeated"] = ORACLES["find_forecast"]
ORACLES["forecast_vs_actual_repeated"] = ORACLES["forecast_vs_actual"]
ORACLES["stream_forecast_vs_actual"] = ORACLES["forecast_vs_actual"]

ORACLES["batches_replayed"] = _with(READINGS_SQL) + """
SELECT event_id, location_id, "timestamp", round(pm25, 6) AS pm25 FROM readings"""
ORACLES["stream_recent_table"] = ORACLES["recent_readings"]
ORACLES["stream_station_overview"] = ORACLES["station_overview"]
ORACLES["forecast_lookup_dated"] = ORACLES["forecast_lookup"]

_USERS = READINGS_SQL.replace("SELECT event_type AS location_id", "SELECT CAST(user_id AS VARCHAR) AS location_id")
_NEXT = """steps AS (
  SELECT location_id, "timestamp", pm25, lead(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp") AS y FROM readings),
known AS (SELECT * FROM steps WHERE y IS NOT NULL)"""
ORACLES["station_linear_models"] = _with(_USERS, _NEXT) + """
SELECT location_id, count(*) AS rows, round(coalesce(regr_intercept(y, pm25), avg(y)), 6) AS intercept,
  round(coalesce(regr_slope(y, pm25), 0), 6) AS slope
FROM known GROUP BY location_id"""
ORACLES["station_linear_metrics"] = _with(_USERS, _NEXT) + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY "timestamp") AS n, count(*) OVER (PARTITION BY location_id) AS total
  FROM known),
lines AS (
  SELECT location_id, coalesce(regr_slope(y, pm25), 0) AS slope, coalesce(regr_intercept(y, pm25), avg(y)) AS base
  FROM ranked WHERE n <= total * 0.8 GROUP BY location_id),
errors AS (
  SELECT r.location_id, y - (base + slope * pm25) AS e FROM ranked r JOIN lines l ON l.location_id = r.location_id WHERE n > total * 0.8)
SELECT location_id, count(*) AS rows, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse
FROM errors GROUP BY location_id"""


# The nearest reading within 20 minutes of an exact number of hours, by as-of joins in both directions.
def _near_hours(steps: dict[str, int]) -> str:
    joins, columns = [], []
    for name, hours in steps.items():
        at = f"t.\"timestamp\" + to_hours({hours})"
        for side, sign in (("b", ">="), ("a", "<=")):
            joins.append(f"ASOF LEFT JOIN readings {side}_{name} ON t.location_id = {side}_{name}.location_id AND {at} {sign} {side}_{name}.\"timestamp\"")
        before = f"(epoch_us({at}) - epoch_us(b_{name}.\"timestamp\"))"
        after = f"(epoch_us(a_{name}.\"timestamp\") - epoch_us({at}))"
        columns.append(
            f"CASE WHEN {before} <= 1200000000 AND ({after} IS NULL OR {before} <= {after}) THEN b_{name}.pm25 "
            f"WHEN {after} <= 1200000000 THEN a_{name}.pm25 END AS {name}"
        )
    return f"near AS (SELECT t.*, {', '.join(columns)} FROM readings t {' '.join(joins)})"


_OFF = {"pm25_lag1": -1, "pm25_lag3": -3, "target_h1": 1, "target_h6": 6}
ORACLES["lags_off_the_hour"] = _with(READINGS_SQL, _near_hours(_OFF)) + f"""
SELECT location_id, "timestamp", {_rounded(["pm25", *_OFF], 9)} FROM near"""
ORACLES["lags_off_the_hour_split_stations"] = ORACLES["lags_off_the_hour"]
ORACLES["stream_forecast_irregular"] = _with(READINGS_SQL, _near_hours({"pm25_lag1": -1, "pm25_lag3": -3})) + """,
full_rows AS (
  SELECT *, avg(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp"
    RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS pm25_mean3 FROM near),
usable AS (SELECT * FROM full_rows WHERE pm25_lag1 IS NOT NULL AND pm25_lag3 IS NOT NULL AND pm25_mean3 IS NOT NULL)
SELECT location_id, location_name, "timestamp", round(pm25, 6) AS pm25,
  round(CASE h WHEN 1 THEN pm25_lag1 ELSE pm25 END, 6) AS predicted_pm25, h::INTEGER AS horizon_hours,
  "timestamp" + to_hours(h) AS forecast_for
FROM usable, (SELECT unnest([1, 6]) AS h)"""

_LINE = """steps AS (
  SELECT *, lead(pm25) OVER (PARTITION BY location_id ORDER BY "timestamp") AS y FROM readings),
line AS (SELECT regr_slope(y, pm25) AS slope, regr_intercept(y, pm25) AS base FROM steps WHERE y IS NOT NULL)"""
ORACLES["linear_model_saved"] = _with(READINGS_SQL, _LINE) + """
SELECT location_id, location_name, "timestamp", round(pm25, 6) AS pm25, round(aqi, 6) AS aqi,
  round(base + slope * pm25, 6) AS predicted_pm25, 1::INTEGER AS horizon_hours, "timestamp" + INTERVAL 1 HOUR AS forecast_for
FROM steps, line WHERE y IS NOT NULL"""
ORACLES["stream_forecast_one_hour"] = _with(READINGS_SQL, HOURLY_SQL, _LAGGED, _LINE) + """
SELECT location_id, location_name, "timestamp", round(pm25, 6) AS pm25, round(aqi, 6) AS aqi,
  round(base + slope * pm25, 6) AS predicted_pm25, 1::INTEGER AS horizon_hours, "timestamp" + INTERVAL 1 HOUR AS forecast_for
FROM lagged, line"""
ORACLES["stream_forecast_versions"] = _with(READINGS_SQL, HOURLY_SQL, _LAGGED) + """
SELECT location_id, "timestamp", h::INTEGER AS horizon_hours,
  round(CASE WHEN "timestamp" < TIMESTAMP '2024-01-16' THEN pm25 ELSE pm25_lag1 END, 9) AS predicted_pm25,
  CASE WHEN "timestamp" < TIMESTAMP '2024-01-16' THEN 'v1' ELSE 'v2' END AS model_version
FROM lagged, (SELECT unnest([1, 24]) AS h)"""
ORACLES["region_scan"] = "SELECT n_name AS region_iso FROM nation"
ORACLES["table_replaced"] = _with(READINGS_SQL) + f" SELECT {READING_LIST} FROM readings"

ORACLES["dense_ranges"] = """
WITH dense AS (
  SELECT event_id, CASE WHEN event_id % 10 = 0 THEN event_type ELSE 'dense' END AS location_id,
    make_timestamp(1704067200000000 + event_id * 3600000) AS "timestamp", value AS pm25
  FROM events)
SELECT event_id, location_id, count(pm25) OVER w AS range_rows, round(sum(pm25) OVER w, 6) AS range_sum,
  round(avg(pm25) OVER w, 9) AS range_mean, round(min(pm25) OVER w, 6) AS range_min, round(max(pm25) OVER w, 6) AS range_max
FROM dense
WINDOW w AS (PARTITION BY location_id ORDER BY "timestamp" RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"""
