"""One function per checked query: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.tables import BOUNDS, CONFIG, SMALL_CHUNKS, dimension, events, present, readings
from sensorcast.config import HORIZONS, MEASURES, SplitConfig, label_name
from sensorcast.functions import bands, calendar
from sensorcast.operators import asof, clean, metrics, profile, ranges, series
from sensorcast.plans import features, registry, reports, station_models, storage, training
from sensorcast.schema import FORECAST_SCHEMA, PAYLOAD_FIELDS, READING_SCHEMA
from sensorcast.sources import compaction, published, readers, streams, writers
from sensorcast.staging import scratch_path
from sensorcast.streaming import lags, recent, verify
from sensorcast.streaming.forecast import feature_stream, read_features, score_stream
from sensorcast.streaming.ingest import ingest_readings

QUERIES = {}
ONCE = {"availableNow": True}
# Means of two-decimal values over 2^n readings can end in a 5 at the seventh digit, where engines round
# a half up or down as its binary form happens to fall; at the ninth they do not for n below 8.
HOURLY_DIGITS = 9


def query(function):
    QUERIES[function.__name__] = function
    return function


def hourly(spark, sf_dir) -> DataFrame:
    return clean.resample_hourly(readings(spark, sf_dir), also=["location_name"])


# Features and labels


def _features(source: DataFrame, config) -> DataFrame:
    rows = features.complete(features.build_features(source, config, [1]), config, [label_name(1)])
    table = rows.select("location_id", "timestamp", *config.features, F.col(label_name(1)).alias("target_pm25"))
    return present(table, 9)


@query
def features_basic(spark, sf_dir):
    return _features(readings(spark, sf_dir), CONFIG)


@query
def features_split_stations(spark, sf_dir):
    return _features(readings(spark, sf_dir), replace(CONFIG, chunking=SMALL_CHUNKS))


@query
def features_many_stations(spark, sf_dir):
    return _features(readings(spark, sf_dir, station="user_id"), CONFIG)


def _time_lags(spark, sf_dir, config):
    rows = features.build_features(hourly(spark, sf_dir), config, HORIZONS)
    return present(
        rows.select(
            "location_id", "timestamp", "pm25", "pm25_lag1", "pm25_lag3", "pm25_mean3", *map(label_name, HORIZONS)
        ),
        HOURLY_DIGITS,
    )


@query
def time_aware_lags(spark, sf_dir):
    return _time_lags(spark, sf_dir, replace(CONFIG, step="hours"))


@query
def time_aware_lags_split_stations(spark, sf_dir):
    return _time_lags(spark, sf_dir, replace(CONFIG, step="hours", chunking=SMALL_CHUNKS))


@query
def station_encode(spark, sf_dir):
    code = features.station_code(F.col("location_id"), CONFIG.station_codes, CONFIG.unknown_code)
    return readings(spark, sf_dir).groupBy("location_id", code.alias("location_code")).agg(F.count("*").alias("rows"))


@query
def calendar_fields(spark, sf_dir):
    ts = F.col("timestamp")
    return present(
        readings(spark, sf_dir, extra=("event_id",)).select(
            "event_id",
            calendar.hour_of_day(ts).alias("hour"),
            calendar.day_of_week_fraction(ts).alias("day_of_week_fraction"),
            calendar.day_of_week(ts).alias("day_of_week"),
            F.month(ts).alias("month"),
            F.dayofmonth(ts).alias("day_of_month"),
            calendar.display_time(ts).alias("local_time"),
        ),
        9,
    )


@query
def horizon_labels(spark, sf_dir):
    wide = features.with_shifts(readings(spark, sf_dir), CONFIG, HORIZONS)
    return present(features.labels_long(wide, HORIZONS, ["location_id", "timestamp", "pm25"]))


@query
def horizon_labels_split_stations(spark, sf_dir):
    config = replace(CONFIG, chunking=SMALL_CHUNKS)
    wide = features.with_shifts(readings(spark, sf_dir), config, HORIZONS)
    return present(features.labels_long(wide, HORIZONS, ["location_id", "timestamp", "pm25"]))


def _split(spark, sf_dir, split, chunking):
    rows = readings(spark, sf_dir).select("location_id", "timestamp", "pm25")
    return present(features.chronological_split(rows, split, chunking))


@query
def chrono_split(spark, sf_dir):
    return _split(spark, sf_dir, SplitConfig(), CONFIG.chunking)


@query
def chrono_split_split_stations(spark, sf_dir):
    return _split(spark, sf_dir, SplitConfig(), SMALL_CHUNKS)


@query
def three_way_split(spark, sf_dir):
    return _split(spark, sf_dir, SplitConfig(train=0.6, validation=0.2, purge=24), CONFIG.chunking)


# Cleaning


@query
def hourly_resample(spark, sf_dir):
    return present(hourly(spark, sf_dir), HOURLY_DIGITS)


def _sensor_text(spark, sf_dir) -> DataFrame:
    """Readings in the layout of the sensor files."""
    decimal = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    return events(spark, sf_dir).select(
        F.date_format("ts", "dd/MM/yyyy").alias("Date"),
        F.date_format("ts", "HH.mm.ss").alias("Time"),
        F.when(F.col("event_id") % 13 == 0, F.lit("-200")).otherwise(decimal).alias("pm25"),
        F.col("user_id").cast("string").alias("no2"),
        "event_id",
    )


@query
def sensor_clean(spark, sf_dir):
    return present(
        clean.clean_sensor_rows(_sensor_text(spark, sf_dir), ["pm25", "no2"]).select("event_id", "timestamp", "pm25", "no2")
    )


@query
def sensor_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "sensor-csv")
    table = _sensor_text(spark, sf_dir).select("Date", "Time", "pm25", "no2", F.col("event_id").cast("string").alias("co"))
    table.withColumns({"_c15": F.lit(""), "_c16": F.lit("")}).write.csv(path, header=True, sep=";")
    return present(readers.read_sensor_csv(spark, path, ["pm25", "no2", "co"]).select("timestamp", "pm25", "no2", "co"))


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "readings-csv")
    text = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    writers.write_csv(readings(spark, sf_dir).withColumn("timestamp", text), path)
    return present(readers.read_readings_csv(spark, path))


@query
def json_roundtrip(spark, sf_dir):
    messages = writers.to_messages(readings(spark, sf_dir))
    return present(clean.accepted(clean.decode_messages(messages.select("value"))))


def _damaged_messages(spark, sf_dir, also=()) -> DataFrame:
    """Every reading as a message, some of them damaged in one of four ways."""
    rows = readings(spark, sf_dir, extra=("event_id",))
    n = F.col("event_id")
    broken = rows.withColumns(
        {
            "location_id": F.when(n % 11 != 0, F.col("location_id")),
            "timestamp": F.when(n % 7 == 0, F.lit("yesterday")).when(
                n % 5 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            ),
        }
    )
    text = F.to_json(F.struct(*[c for c in broken.columns if c != "event_id"]))
    return broken.select(*also, F.when(n % 13 == 0, F.concat(F.lit("<"), text)).otherwise(text).alias("value"))


@query
def message_quarantine(spark, sf_dir):
    decoded = clean.decode_messages(_damaged_messages(spark, sf_dir))
    return decoded.groupBy(F.coalesce(clean.REJECT, F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("messages"))


@query
def payload_flatten(spark, sf_dir):
    """One payload per station and day, which holds at most 24 hours, then back to rows."""
    rows = hourly(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    entry = F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"), *MEASURES)
    days = rows.groupBy("location_id", "day").agg(F.sort_array(F.collect_list(entry)).alias("h"))
    block = F.struct(F.col("h.time").alias("time"), *[F.col(f"h.{m}").alias(f) for f, m in PAYLOAD_FIELDS.items()])
    payloads = days.select("location_id", F.to_json(F.struct(block.alias("hourly"))).alias("payload"))
    return present(readers.flatten_payload(payloads, F.col("payload"), ["location_id"]), HOURLY_DIGITS)


@query
def range_check(spark, sf_dir):
    rows = readings(spark, sf_dir, extra=("event_id",))
    flagged = clean.flag_out_of_range(rows, BOUNDS)
    return present(clean.null_out_of_range(flagged, BOUNDS).select("event_id", *BOUNDS, "out_of_range"))


@query
def outlier_bounds(spark, sf_dir):
    return present(clean.quantile_bounds(readings(spark, sf_dir), MEASURES, 0.01, 0.99))


def _disturbed(spark, sf_dir):
    """Readings of all users as stations; some values are infinite, not a number or missing."""
    number = F.col("event_id") % 50
    special = F.when(number == 0, F.lit(float("inf"))).when(number == 1, F.lit(float("-inf")))
    special = special.when(number == 2, F.lit(float("nan"))).when(number != 3, F.col("pm25"))
    rows = readings(spark, sf_dir, station="user_id", extra=("event_id",))
    return rows.withColumns({"pm25": special, "so2": F.lit(1.0) - F.col("pm25")})


@query
def outlier_bounds_per_station(spark, sf_dir):
    return present(clean.quantile_bounds(_disturbed(spark, sf_dir), ["pm25", "co", "so2"], 0.05, 0.95, ["location_id"]))


@query
def outliers_per_station(spark, sf_dir):
    rows = _disturbed(spark, sf_dir)
    measures = ["pm25", "so2"]
    flagged = clean.flag_outliers(rows, clean.quantile_bounds(rows, measures, 0.25, 0.75, ["location_id"]), measures)
    return present(flagged.select("event_id", "location_id", "outliers"))


@query
def dedupe_last(spark, sf_dir):
    rows = readings(spark, sf_dir)
    first = rows.withColumn("ingest_seq", F.lit(1))
    second = rows.withColumns({"ingest_seq": F.lit(2), "pm25": F.col("pm25") + 1})
    return present(clean.keep_last(first.unionByName(second), ["ingest_seq"]))


@query
def drop_missing(spark, sf_dir):
    sensor = clean.clean_sensor_rows(_sensor_text(spark, sf_dir), ["pm25", "no2"])
    return present(clean.drop_incomplete(sensor, ["pm25", "timestamp"]).select("event_id", "timestamp", "pm25"))


@query
def dataset_profile(spark, sf_dir):
    return present(profile.profile(readings(spark, sf_dir), bounds=BOUNDS))


@query
def cadence_histogram(spark, sf_dir):
    return profile.cadence(hourly(spark, sf_dir))


@query
def station_counts(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("location_id").agg(F.count("*").alias("rows"))


@query
def storage_comparison(spark, sf_dir):
    return storage.compare_formats(readings(spark, sf_dir), "pm25")


@query
def storage_contents(spark, sf_dir):
    made = storage.compare_formats(readings(spark, sf_dir), "pm25", ("csv", "parquet", "orc", "json"), repeats=1)
    return present(made.select("format", "rows", "mean"))


# Forecast quality


@query
def persistence_metrics(spark, sf_dir):
    wide = features.with_shifts(readings(spark, sf_dir), CONFIG, HORIZONS)
    long = features.labels_long(wide, HORIZONS, ["pm25"])
    quality = metrics.regression_metrics(long, F.col("target"), F.col("pm25"), ["horizon_hours"])
    return present(metrics.with_rating(quality))


@query
def band_histogram(spark, sf_dir):
    rows = readings(spark, sf_dir).select(
        bands.band_label(F.col("aqi"), bands.AQI_BANDS).alias("aqi_band"),
        bands.band_label(F.col("pm25"), bands.PM25_BANDS).alias("pm25_band"),
        bands.band_label(F.col("aqi"), bands.SIMPLE_AQI_BANDS).alias("simple_band"),
    )
    return rows.groupBy("aqi_band", "pm25_band", "simple_band").agg(F.count("*").alias("rows"))


def _confusion(spark, sf_dir):
    wide = features.with_shifts(readings(spark, sf_dir), CONFIG, [1])
    band = lambda c: bands.band_label(F.col(c), bands.PM25_BANDS)
    return metrics.confusion(wide, band(label_name(1)), band("pm25"))


@query
def band_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query
def band_scores(spark, sf_dir):
    return present(metrics.band_scores(_confusion(spark, sf_dir)))


@query
def forecast_vs_actual(spark, sf_dir):
    rows = hourly(spark, sf_dir)
    return present(reports.forecast_vs_actual(training.persistence_forecasts(rows, HORIZONS), rows), HOURLY_DIGITS)


# Reports


@query
def latest_per_station(spark, sf_dir):
    return present(series.latest(readings(spark, sf_dir)))


@query
def latest_with_delta(spark, sf_dir):
    return present(series.latest_with_change(readings(spark, sf_dir), ["pm25", "pm10"]))


@query
def nearest_reading(spark, sf_dir):
    return present(series.nearest(readings(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp")))


def _instants(spark, sf_dir):
    """An instant to ask for per event; every tenth in the middle of an hour, as near to one full hour as to the next."""
    half = (F.date_trunc("hour", "ts") + F.expr("INTERVAL 30 MINUTES")).cast("timestamp")
    asked = F.when(F.col("event_id") % 10 == 0, half).otherwise(F.col("ts").cast("timestamp"))
    return events(spark, sf_dir).select("event_id", F.col("event_type").alias("location_id"), asked.alias("timestamp"))


def _nearest_readings(spark, sf_dir, chunking, **options):
    """The hourly readings nearest to each event of their station."""
    hours = hourly(spark, sf_dir).select("location_id", "timestamp", "pm25")
    found = asof.asof_join(_instants(spark, sf_dir), hours, chunking=chunking, **options)
    near = [F.col("near.timestamp").alias("near_timestamp"), F.col("near.pm25").alias("near_pm25")]
    return present(found.select("event_id", "location_id", "timestamp", *near), HOURLY_DIGITS)


@query
def nearest_readings(spark, sf_dir):
    return _nearest_readings(spark, sf_dir, CONFIG.chunking)


@query
def nearest_readings_split_stations(spark, sf_dir):
    return _nearest_readings(spark, sf_dir, SMALL_CHUNKS)


@query
def readings_before(spark, sf_dir):
    """The last hour before each event, if it is less than 20 minutes ago; in chunks."""
    return _nearest_readings(spark, sf_dir, SMALL_CHUNKS, direction="before", tolerance_seconds=1200)


@query
def forecast_fanout(spark, sf_dir):
    return present(training.persistence_forecasts(readings(spark, sf_dir), HORIZONS))


def _forecasts_but_view(spark, sf_dir):
    """A forecast table in which one station has not been scored yet."""
    scored = readings(spark, sf_dir).filter(F.col("location_id") != "view")
    return training.persistence_forecasts(scored, HORIZONS)


@query
def forecast_lookup(spark, sf_dir):
    newest = series.latest(readings(spark, sf_dir)).select("location_id", "timestamp", "pm25")
    return present(reports.forecast_lookup(newest, _forecasts_but_view(spark, sf_dir), 6))


@query
def find_forecast(spark, sf_dir):
    """The forecast of the first click reading of the table, 12 hours ahead."""
    rows = readings(spark, sf_dir)
    first = rows.filter(F.col("location_id") == "click").agg(F.min("timestamp").alias("t")).scalar()
    return present(reports.find_forecast(training.persistence_forecasts(rows, HORIZONS), "click", first, 12))


@query
def station_filter(spark, sf_dir):
    return present(readings(spark, sf_dir).filter(F.col("location_id") == "purchase"))


@query
def station_overview(spark, sf_dir):
    return present(reports.station_overview(readings(spark, sf_dir), dimension(spark)))


@query
def region_overlay(spark, sf_dir):
    regions = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("region_iso"))
    overview = reports.station_overview(readings(spark, sf_dir), dimension(spark))
    return present(reports.region_overlay(regions, overview))


@query
def colour_ceiling(spark, sf_dir):
    return present(reports.colour_ceiling(series.latest(readings(spark, sf_dir))))


@query
def station_detail(spark, sf_dir):
    return present(reports.station_detail(readings(spark, sf_dir), _forecasts_but_view(spark, sf_dir), 6))


@query
def station_series(spark, sf_dir):
    return present(reports.station_series(readings(spark, sf_dir)))


@query
def recent_readings(spark, sf_dir):
    return present(reports.recent_readings(readings(spark, sf_dir)))


@query
def recent_days(spark, sf_dir):
    return present(series.last_days(readings(spark, sf_dir), 7))


@query
def station_list(spark, sf_dir):
    return series.station_list(readings(spark, sf_dir))


@query
def time_ordered_history(spark, sf_dir):
    return present(reports.clean_history(readings(spark, sf_dir)))


@query
def alerts(spark, sf_dir):
    rows = readings(spark, sf_dir, extra=("event_id",)).select("event_id", "location_id", "timestamp", "aqi")
    return present(reports.alerts(rows, "aqi", 4))


# Models


@query
def vector_assembly(spark, sf_dir):
    """The model input vector, taken apart again."""
    rows = features.complete(features.build_features(readings(spark, sf_dir), CONFIG), CONFIG)
    vector = VectorAssembler(inputCols=CONFIG.features, outputCol="features").transform(rows)
    parts = vector.select("location_id", "timestamp", vector_to_array("features").alias("v"))
    return present(
        parts.select("location_id", "timestamp", *[F.col("v")[i].alias(f"v_{f}") for i, f in enumerate(CONFIG.features)]), 9
    )


def _training_rows(source, config):
    """Everything that decides which rows each horizon's model learns from and is tested on."""
    table = training.training_table(source, config, HORIZONS)
    split = SplitConfig()
    flags = [training.in_training(h, split).alias(f"train_h{h}") for h in HORIZONS]
    flags += [training.in_test(h, split).alias(f"test_h{h}") for h in HORIZONS]
    labels = [label_name(h) for h in HORIZONS]
    shown = table.select("location_id", "timestamp", "pm25_mean3", *labels, "series_rank", "series_rows", *flags)
    return present(shown, HOURLY_DIGITS if config.step == "hours" else 6)


@query
def training_rows(spark, sf_dir):
    return _training_rows(readings(spark, sf_dir), CONFIG)


@query
def training_rows_split_stations(spark, sf_dir):
    return _training_rows(readings(spark, sf_dir), replace(CONFIG, chunking=SMALL_CHUNKS))


@query
def training_rows_hours(spark, sf_dir):
    """Hourly rows with gaps, so that labels are missing anywhere in the series."""
    return _training_rows(hourly(spark, sf_dir), replace(CONFIG, step="hours"))


@query
def training_rows_hours_split_stations(spark, sf_dir):
    return _training_rows(hourly(spark, sf_dir), replace(CONFIG, step="hours", chunking=SMALL_CHUNKS))


@query
def rf_one_hour(spark, sf_dir):
    return training.one_hour_model(readings(spark, sf_dir), CONFIG)[1]


@query
def linear_one_hour(spark, sf_dir):
    return training.one_hour_model(readings(spark, sf_dir), CONFIG, training.linear())[1]


@query
def gbt_one_hour(spark, sf_dir):
    return training.one_hour_model(readings(spark, sf_dir), CONFIG, training.boosted())[1]


@query
def best_model(spark, sf_dir):
    kinds = {"forest": training.forest(), "linear": training.linear(), "boosted": training.boosted()}
    return training.best_by_validation(readings(spark, sf_dir), kinds, CONFIG)[2]


@query
def per_station_models(spark, sf_dir):
    """Hold-out metrics of a linear model per station over all features."""
    parts = training.next_step_table(readings(spark, sf_dir), CONFIG, SplitConfig())
    return station_models.station_metrics(parts, CONFIG.features, label_name(1))[1]


@query
def station_linear_models(spark, sf_dir):
    """A line per station from its value to the next one, for all users as stations."""
    rows = features.with_shifts(readings(spark, sf_dir, station="user_id"), CONFIG, [1])
    models = station_models.fit_stations(rows, ["pm25"], label_name(1))
    return present(models.select("location_id", "rows", "intercept", F.col("coefficients")[0].alias("slope")))


@query
def station_linear_metrics(spark, sf_dir):
    """Hold-out errors of those lines, fitted on the first 80 % of each station."""
    rows = features.with_shifts(readings(spark, sf_dir, station="user_id"), CONFIG, [1]).dropna(subset=[label_name(1)])
    parts = features.chronological_split(rows.drop("_chunk"), SplitConfig(), CONFIG.chunking)
    found = station_models.station_metrics(parts, ["pm25"], label_name(1))[1]
    return present(found.select("location_id", "rows", "mae", "rmse"))


@query
def rf_multi_horizon(spark, sf_dir):
    """Train, store, load and apply a model per horizon."""
    source = readings(spark, sf_dir)
    table = training.training_table(source, CONFIG, HORIZONS)
    root = scratch_path(spark, "models")
    training.save_models(spark, training.train_horizons(table, CONFIG, HORIZONS), root)
    models = training.load_models(spark, root)
    rows = features.complete(features.build_features(source, CONFIG), CONFIG)
    return present(training.forecasts_long(training.score_horizons(rows, models, spread=True), HORIZONS))


@query
def holdout_metrics(spark, sf_dir):
    table = training.training_table(readings(spark, sf_dir), CONFIG, HORIZONS)
    models = training.train_horizons(table, CONFIG, HORIZONS)
    return training.holdout_metrics(table, models)


# Streams


def _finish(queries):
    for q in queries:
        q.awaitTermination()


@query
def stream_ingest(spark, sf_dir):
    """Every reading twice as messages; each lands once."""
    inbox, landed, state = (scratch_path(spark, n) for n in ("inbox", "landed", "ingest-state"))
    messages = writers.to_messages(readings(spark, sf_dir)).select("value")
    messages.unionByName(messages).write.text(inbox)
    source = streams.message_stream(spark, "json", inbox)
    _finish([ingest_readings(source, landed, state, dedupe_within="40 days", trigger=ONCE)])
    return present(readers.read_landed(spark, landed).select(READING_SCHEMA.names))


def _outcomes(spark, landed: str) -> DataFrame:
    """Messages per reason to reject them, and accepted ones."""
    rejects = readers.read_rejects(spark, landed).select(F.col(clean.REJECT).alias("outcome"))
    taken = readers.read_landed(spark, landed).select(F.lit("accepted").alias("outcome"))
    return rejects.unionByName(taken).groupBy("outcome").agg(F.count("*").alias("messages"))


@query
def stream_rejects(spark, sf_dir):
    inbox, landed, state = (scratch_path(spark, n) for n in ("inbox", "landed", "ingest-state"))
    _damaged_messages(spark, sf_dir).write.text(inbox)
    source = streams.message_stream(spark, "json", inbox)
    _finish([ingest_readings(source, landed, state, trigger=ONCE)])
    return _outcomes(spark, landed)


@query
def stream_late_readings(spark, sf_dir):
    """One half of the messages arrives, then all of them: days late, and the half once more. Readings
    land once, whatever their age, and every reject is kept."""
    inbox, landed, state = (scratch_path(spark, n) for n in ("inbox", "landed", "ingest-state"))
    messages = _damaged_messages(spark, sf_dir, also=("event_id",))
    for arriving in (messages.filter("event_id % 2 = 0"), messages):
        arriving.select("value").write.mode("append").text(inbox)
        source = streams.message_stream(spark, "json", inbox)
        _finish([ingest_readings(source, landed, state, dedupe_within="2 hours", trigger=ONCE)])
    return _outcomes(spark, landed)


def _landed_hours(spark, sf_dir) -> str:
    """The hourly series as a stream would have landed it; returns its folder."""
    landed = scratch_path(spark, "landed")
    source = hourly(spark, sf_dir).drop("readings").withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})
    source.withColumn("reading_date", F.to_date("timestamp")).write.partitionBy("reading_date").parquet(landed)
    return landed


def _feature_rows(spark, landed: str, config) -> str:
    """Run the feature stream over everything landed; returns the folder of its output."""
    rows, state = scratch_path(spark, "feature-rows"), scratch_path(spark, "feature-state")
    history = lambda session: readers.read_landed(session, landed)
    stream = streams.reading_stream(spark, landed)
    _finish([feature_stream(stream, history, rows, state, "run-1", config, trigger=ONCE)])
    return rows


@query
def stream_features(spark, sf_dir):
    config = replace(CONFIG, step="hours")
    rows = _feature_rows(spark, _landed_hours(spark, sf_dir), config)
    return present(read_features(spark, rows, config).drop("run_id", "batch_id"), 9)


@query
def stream_forecast(spark, sf_dir):
    """Land the hourly series, then forecast every landed reading with models trained on it."""
    config = replace(CONFIG, step="hours")
    landed = _landed_hours(spark, sf_dir)
    table = training.training_table(readers.read_landed(spark, landed), config, HORIZONS)
    models = training.train_horizons(table, config, HORIZONS)
    rows, out = _feature_rows(spark, landed, config), scratch_path(spark, "forecasts")
    _finish([score_stream(spark, rows, models, out, scratch_path(spark, "score-state"), config, trigger=ONCE)])
    return present(readers.read_forecasts(spark, out).select(FORECAST_SCHEMA.names))


@query
def stream_alerts(spark, sf_dir):
    landed, out = _landed_hours(spark, sf_dir), scratch_path(spark, "alerts")
    found = reports.alerts(streams.reading_stream(spark, landed), "aqi", 3)
    found = found.select("location_id", "timestamp", "aqi", "alert_label")
    sink = found.writeStream.format("parquet").option("path", out).trigger(**ONCE)
    _finish([sink.option("checkpointLocation", scratch_path(spark, "alert-state")).start()])
    return present(spark.read.schema(found.schema).parquet(out), HOURLY_DIGITS)


def _land(df, path: str) -> None:
    dated = df.withColumns({"ingested_at": F.current_timestamp(), "reading_date": F.to_date("timestamp")})
    dated.write.mode("append").partitionBy("reading_date").parquet(path)


def _day(text: str):
    return F.lit(f"2024-01-{text} 00:00:00").cast("timestamp")


@query
def stream_features_rows(spark, sf_dir):
    """Three landings of all readings. Those of one station go on 60 days later from the 20th on; a tenth of the last day
    before the second landing comes with that one, where another station begins."""
    gap = F.when((F.col("location_id") == "view") & (F.col("timestamp") >= _day("20")), F.expr("INTERVAL 60 DAYS"))
    source = readings(spark, sf_dir, extra=("event_id",))
    source = source.withColumn("timestamp", F.col("timestamp") + F.coalesce(gap, F.expr("INTERVAL 0 DAYS")))
    ts, n = F.col("timestamp"), F.col("event_id")
    late = (ts >= _day("11")) & (n % 10 == 0) | (F.col("location_id") == "signup")
    landing = F.when((ts < _day("12")) & ~late, 1).when(ts < _day("21"), 2).otherwise(3)
    landed, rows, state = (scratch_path(spark, x) for x in ("landed", "row-features", "row-state"))
    for k in (1, 2, 3):
        _land(source.filter(landing == k).drop("event_id"), landed)
        stream = streams.reading_stream(spark, landed)
        _finish([lags.row_feature_stream(stream, rows, state, CONFIG, lateness_hours=72, trigger=ONCE)])
    return present(lags.read_row_features(spark, rows, CONFIG).drop("revision"), 9)


def _versions(forecasts: DataFrame) -> DataFrame:
    """Each forecast as a second run made it, after a first run that foretold more."""
    first = forecasts.withColumns({"predicted_pm25": F.col("predicted_pm25") + 40, "scored_at": _day("01"), "revision": F.lit(9)})
    second = forecasts.withColumns({"scored_at": _day("02"), "revision": F.lit(0)})
    return first.unionByName(second)


@query
def find_forecast_repeated(spark, sf_dir):
    """As ``find_forecast``, where an earlier run had foretold more."""
    rows = readings(spark, sf_dir)
    first = rows.filter(F.col("location_id") == "click").agg(F.min("timestamp").alias("t")).scalar()
    made = _versions(training.persistence_forecasts(rows, HORIZONS))
    return present(reports.find_forecast(made, "click", first, 12).select(FORECAST_SCHEMA.names))


@query
def forecast_vs_actual_repeated(spark, sf_dir):
    """As ``forecast_vs_actual``, where forecasts were made twice and each reading was corrected downwards."""
    rows = hourly(spark, sf_dir)
    wrong = rows.withColumns({"pm25": F.col("pm25") + 7, "ingested_at": _day("01"), "source_offset": F.lit(5)})
    right = rows.withColumns({"ingested_at": _day("01"), "source_offset": F.lit(6)})
    made = _versions(training.persistence_forecasts(rows, HORIZONS))
    found = reports.forecast_vs_actual(made, wrong.unionByName(right))
    return present(found.drop("scored_at", "revision"), HOURLY_DIGITS)


@query
def stream_forecast_vs_actual(spark, sf_dir):
    """Forecasts and readings land in three parts each; a fifth of the readings of a part's last day comes with the
    next one, and all forecasts were made twice."""
    rows = hourly(spark, sf_dir).drop("readings")
    ts = F.col("timestamp")
    landing = lambda shown: F.when(shown < _day("11"), 1).when(shown < _day("21"), 2).otherwise(3)
    waits = F.when(F.hour(ts) % 5 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAYS"))
    made = _versions(training.persistence_forecasts(rows, HORIZONS)).withColumn("forecast_date", F.to_date(ts))
    landed, stored, out, state = (scratch_path(spark, x) for x in ("landed", "forecasts", "errors", "error-state"))
    for k in (1, 2, 3):
        made.filter(landing(ts) == k).withColumn("revision", F.col("revision").cast("long")).write.mode("append").partitionBy(
            "forecast_date"
        ).parquet(stored)
        _land(rows.filter(landing(ts + waits) == k), landed)
        forecasts = verify.stored_forecast_stream(spark, stored)
        _finish([verify.verification_stream(forecasts, streams.reading_stream(spark, landed), out, state, "2 days", trigger=ONCE)])
    return present(verify.read_errors(spark, out), HOURLY_DIGITS)


@query
def batches_replayed(spark, sf_dir):
    """One batch published; of another half the rows are written, then the job dies, and the batch comes again, twice."""
    path = scratch_path(spark, "published")
    rows = readings(spark, sf_dir, extra=("event_id",))
    first, second = rows.filter(F.col("timestamp") < _day("16")), rows.filter(F.col("timestamp") >= _day("16"))
    published.publish_batch(first, path, "run-1", 0)
    published.write_attempt(second.filter("event_id % 2 = 0"), path, "run-1", 1)
    for _ in range(2):
        published.publish_batch(second, path, "run-1", 1)
    return present(published.read_published(spark, path, rows.schema).select("event_id", "location_id", "timestamp", "pm25"))


@query
def landed_compacted(spark, sf_dir):
    """Messages land in four parts, some of them damaged; after the second and the third part small files are rewritten,
    once by a job that dies before its commit. Every message is read once."""
    inbox, landed, state, compacted = (scratch_path(spark, x) for x in ("inbox", "landed", "ingest-state", "compacted"))
    messages = _damaged_messages(spark, sf_dir, also=("event_id",))
    for part in range(4):
        messages.filter(F.col("event_id") % 4 == part).select("value").coalesce(2).write.mode("append").text(inbox)
        _finish([ingest_readings(streams.message_stream(spark, "json", inbox), landed, state, trigger=ONCE)])
        if part == 2:
            half = readers.accepted_rows(compaction.read_compacted(spark, landed, compacted)).limit(100)
            published.write_attempt(half, f"{compacted}/rows", compaction.RUN_ID, 1, ["reading_date"])
        if part in (1, 2):
            compaction.compact(spark, landed, compacted, rows_per_file=1000)
    rows = compaction.read_compacted(spark, landed, compacted)
    read = lambda name: F.when(F.col(clean.REJECT).isNull(), F.col(name)).alias(name)
    outcome = F.coalesce(clean.REJECT, F.lit("accepted")).alias("outcome")
    return present(rows.select(outcome, read("location_id"), read("timestamp"), *map(read, MEASURES)))


def _recent_table(spark, sf_dir) -> str:
    """The table of newest readings after three landings, of which the last has late and corrected readings, and after a
    replay of the second batch; returns its folder."""
    landed, table, state = (scratch_path(spark, x) for x in ("landed", "recent", "recent-state"))
    rows = readings(spark, sf_dir, extra=("event_id",))
    ts, n = F.col("timestamp"), F.col("event_id")
    late = (ts >= _day("30")) & (n % 10 == 0)
    wrong = F.when((ts >= _day("30")) & (n % 7 == 0), F.lit(1000.0)).otherwise(F.lit(0.0))
    parts = [
        rows.filter(ts < _day("20")),
        rows.filter((ts >= _day("20")) & ~late).withColumn("pm25", F.col("pm25") + wrong),
        rows.filter(late | ((ts >= _day("30")) & (n % 7 == 0))),
    ]
    for k, part in enumerate(parts):
        _land(part.drop("event_id"), landed)
        _finish([recent.recent_stream(streams.reading_stream(spark, landed), table, state, "run-1", trigger=ONCE)])
        if k == 1:
            recent.merge_batch(readers.read_landed(spark, landed), 1, table, "run-1")
    return table


@query
def stream_recent_table(spark, sf_dir):
    return present(reports.recent_readings(recent.read_recent(spark, _recent_table(spark, sf_dir))))


@query
def stream_station_overview(spark, sf_dir):
    """The overview from the small table instead of all history."""
    newest = recent.read_recent(spark, _recent_table(spark, sf_dir)).select(READING_SCHEMA.names)
    return present(reports.station_overview(newest, dimension(spark)))


@query
def forecast_lookup_dated(spark, sf_dir):
    """As ``forecast_lookup``, from forecasts stored in a folder per date, twice each."""
    path, table = scratch_path(spark, "forecasts"), scratch_path(spark, "recent")
    made = _versions(_forecasts_but_view(spark, sf_dir)).withColumn("revision", F.col("revision").cast("long"))
    made.withColumn("forecast_date", F.to_date("timestamp")).write.partitionBy("forecast_date").parquet(path)
    landed = readings(spark, sf_dir).withColumns({"ingested_at": F.current_timestamp(), "source_offset": F.lit(0).cast("long")})
    recent.merge_batch(landed, 0, table, "run-1")
    newest = series.recent(recent.read_recent(spark, table), 1).select("location_id", "timestamp", "pm25")
    return present(reports.forecast_lookup(newest, readers.read_forecasts(spark, path), 6))


# Readings off the hour, stored models and their versions


def _dense(spark, sf_dir):
    """The readings at 1,000 an hour, nine of ten in one station."""
    station = F.when(F.col("event_id") % 10 == 0, F.col("location_id")).otherwise(F.lit("dense"))
    instant = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 3_600_000)
    return readings(spark, sf_dir, extra=("event_id",)).withColumns({"location_id": station, "timestamp": instant})


@query
def dense_ranges(spark, sf_dir):
    """Sums over the readings of one to three hours before, in slots of seven minutes."""
    slot = timedelta(minutes=7)
    found = ranges.range_aggregates(_dense(spark, sf_dir), "pm25", timedelta(hours=3), timedelta(hours=1), slot)
    shown = found.withColumn("range_sum", F.round("range_sum", 6))
    names = [f"range_{n}" for n in ("rows", "sum", "mean", "min", "max")]
    return present(shown.select("event_id", "location_id", *names), HOURLY_DIGITS)


def _off_the_hour(spark, sf_dir, chunking):
    config = replace(CONFIG, step="hours", tolerance_minutes=20, chunking=chunking)
    rows = features.build_features(readings(spark, sf_dir), config, [1, 6])
    return present(rows.select("location_id", "timestamp", "pm25", "pm25_lag1", "pm25_lag3", "target_h1", "target_h6"), 9)


@query
def lags_off_the_hour(spark, sf_dir):
    return _off_the_hour(spark, sf_dir, CONFIG.chunking)


@query
def lags_off_the_hour_split_stations(spark, sf_dir):
    return _off_the_hour(spark, sf_dir, SMALL_CHUNKS)


def _landed_events(spark, sf_dir) -> str:
    landed = scratch_path(spark, "landed")
    _land(readings(spark, sf_dir), landed)
    return landed


@query
def stream_forecast_irregular(spark, sf_dir):
    """Forecasts of readings at any minute: their lags are the nearest readings within 20 minutes."""
    config = replace(CONFIG, step="hours", tolerance_minutes=20)
    landed, out = _landed_events(spark, sf_dir), scratch_path(spark, "forecasts")
    rows = _feature_rows(spark, landed, config)
    models = {1: training.persistence_model(config, "pm25_lag1"), 6: training.persistence_model(config)}
    _finish([score_stream(spark, rows, models, out, scratch_path(spark, "score-state"), config, trigger=ONCE)])
    made = readers.read_forecasts(spark, out).select(FORECAST_SCHEMA.names)
    return present(made.drop("aqi"))


def _line(spark, sf_dir):
    """The straight line from each reading to the next of its station, as a Spark ML model, and the rows it was fitted on."""
    rows = features.with_shifts(readings(spark, sf_dir), CONFIG, [1]).dropna(subset=[label_name(1)])
    label = label_name(1)
    return training.pipeline(["pm25"], training.linear()(label)).fit(rows.select("pm25", label)), rows


@query
def linear_model_saved(spark, sf_dir):
    """Forecasts of a linear model that was stored, loaded and, the second time, not trained again."""
    model, rows = _line(spark, sf_dir)
    root = scratch_path(spark, "models")
    for _ in range(2):
        models = training.load_or_train(spark, root, lambda: {1: model})
    return present(training.forecasts_long(training.score_horizons(rows, models), [1]))


@query
def stream_forecast_one_hour(spark, sf_dir):
    """The one-hour job: one stored model on the rows of the feature stream."""
    config = replace(CONFIG, step="hours")
    landed, root, out = _landed_hours(spark, sf_dir), scratch_path(spark, "models"), scratch_path(spark, "forecasts")
    training.save_models(spark, {1: _line(spark, sf_dir)[0]}, root)
    rows = _feature_rows(spark, landed, config)
    models = training.load_models(spark, root)
    _finish([score_stream(spark, rows, models, out, scratch_path(spark, "score-state"), config, trigger=ONCE)])
    return present(readers.read_forecasts(spark, out).select(FORECAST_SCHEMA.names))


@query
def stream_forecast_versions(spark, sf_dir):
    """Half of the series is forecast by one version of the models, then another one becomes current."""
    config = replace(CONFIG, step="hours")
    source = hourly(spark, sf_dir).drop("readings")
    landed, rows, root, out, first, second = (
        scratch_path(spark, x) for x in ("landed", "features", "registry", "forecasts", "feature-state", "score-state")
    )
    history = lambda session: readers.read_landed(session, landed)
    for version, column, part in (("v1", "pm25", F.col("timestamp") < _day("16")), ("v2", "pm25_lag1", F.col("timestamp") >= _day("16"))):
        registry.add_version(spark, {h: training.persistence_model(config, column) for h in (1, 24)}, root, version)
        _land(source.filter(part), landed)
        stream = streams.reading_stream(spark, landed)
        _finish([feature_stream(stream, history, rows, first, "run-1", config, trigger=ONCE)])
        _finish([registry.reloading_score_stream(spark, rows, root, out, second, "run-1", config, ONCE)])
    made = registry.read_versioned_forecasts(spark, out)
    return present(made.select("location_id", "timestamp", "horizon_hours", "predicted_pm25", "model_version"), HOURLY_DIGITS)


@query
def region_scan(spark, sf_dir):
    """Region codes from a GeoJSON file, here made of the nations."""
    path = scratch_path(spark, "regions")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("shapeISO"), "n_nationkey").alias("properties"))
    nation.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).write.text(path)
    return readers.read_regions(spark, path)


@query
def table_replaced(spark, sf_dir):
    """A table that is written twice holds what was written last."""
    path, rows = scratch_path(spark, "replaced"), readings(spark, sf_dir)
    writers.write_table(rows.withColumn("pm25", F.col("pm25") + 1), path)
    writers.write_table(rows, path)
    return present(readers.read_readings_parquet(spark, path))
