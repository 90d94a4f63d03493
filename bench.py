"""Time the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES, hourly  # noqa: E402
from catalog.tables import CONFIG, readings  # noqa: E402
from sensorcast.config import HORIZONS  # noqa: E402
from sensorcast.plans import training  # noqa: E402
from sensorcast.sources import readers, streams  # noqa: E402
from sensorcast.staging import scratch_path  # noqa: E402
from sensorcast.streaming import forecast  # noqa: E402

PLAIN = (
    "features_basic",
    "features_split_stations",
    "features_many_stations",
    "time_aware_lags",
    "horizon_labels",
    "chrono_split",
    "hourly_resample",
    "dedupe_last",
    "json_roundtrip",
    "dataset_profile",
    "persistence_metrics",
    "band_scores",
    "forecast_vs_actual",
    "latest_with_delta",
    "nearest_reading",
    "station_overview",
    "station_detail",
    "recent_readings",
    "stream_ingest",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best_of(times: int, job) -> float:
    spent = []
    for _ in range(times):
        start = time.perf_counter()
        job()
        spent.append(time.perf_counter() - start)
    return min(spent)


def model_times(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Training, evaluation and scoring of one model per horizon, 1 to 24 hours."""
    out = {}
    source = readings(spark, sf_dir)

    start = time.perf_counter()
    table = training.training_table(source, CONFIG, HORIZONS)
    out["training_table_24"] = time.perf_counter() - start

    root = scratch_path(spark, "models")
    start = time.perf_counter()
    training.save_models(spark, training.train_horizons(table, CONFIG, HORIZONS, parallelism=8), root, 8)
    out["train_and_save_24"] = time.perf_counter() - start
    out["train_and_save_per_horizon"] = out["train_and_save_24"] / len(HORIZONS)

    start = time.perf_counter()
    models = training.load_models(spark, root, parallelism=8)
    out["load_24"] = time.perf_counter() - start

    out["holdout_metrics_24"] = best_of(2, lambda: run(training.holdout_metrics(table, models)))

    return out | stream_times(spark, sf_dir, models)


def stream_times(spark: SparkSession, sf_dir: str, models) -> dict[str, float]:
    """Latency of the running forecast jobs for micro-batches of one new hour per station."""
    landed, rows, forecasts, state = (scratch_path(spark, n) for n in ("landed", "rows", "forecasts", "state"))
    # Features in hours want a regular series: the raw events have no reading exactly an hour before.
    source = hourly(spark, sf_dir).drop("readings").withColumns({"latitude": F.lit(0.0), "longitude": F.lit(0.0)})
    dated = source.withColumn("reading_date", F.to_date("timestamp"))
    newest_first = Window.partitionBy("location_id").orderBy(F.col("timestamp").desc())
    numbered = dated.withColumn("n", F.row_number().over(newest_first)).persist()

    def land(which) -> None:
        numbered.filter(which).drop("n").write.mode("append").partitionBy("reading_date").parquet(landed)

    land(F.col("n") > 5)
    stream = streams.reading_stream(spark, landed)
    # Hours as features and one day of history; the landed backlog is the first micro-batch.
    first = forecast.feature_stream(
        stream, lambda s: readers.read_landed(s, landed), rows, f"{state}/f", "bench", replace(CONFIG, step="hours"), lookback_hours=24
    )
    first.processAllAvailable()
    second = forecast.score_stream(spark, rows, models, forecasts, f"{state}/s", CONFIG)
    second.processAllAvailable()
    spent = {"stream_features_batch": [], "stream_score_batch_24_horizons": []}
    for n in range(5, 0, -1):
        land(F.col("n") == n)
        for name, running in zip(spent, (first, second)):
            running.processAllAvailable()
            done = [p["durationMs"]["triggerExecution"] for p in running.recentProgress if p["numInputRows"] > 0]
            if not done:
                raise RuntimeError(f"{name}: no row reached the stream")
            spent[name].append(done[-1] / 1000)
    first.stop()
    second.stop()
    return {name: min(times) for name, times in spent.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    spark.range(1000).count()
    seconds = {}
    for name in PLAIN:
        seconds[name] = best_of(3, lambda: run(QUERIES[name](spark, sf_dir)))
        print(f"{name}: {seconds[name]:.3f}", file=sys.stderr, flush=True)
    seconds |= model_times(spark, sf_dir)
    for row in QUERIES["storage_comparison"](spark, sf_dir).collect():
        seconds[f"scan_one_column_{row['format']}"] = row["scan_seconds"]
        print(f"{row['format']}: {row['bytes']} bytes", file=sys.stderr)
    for name in list(seconds)[len(PLAIN):]:
        print(f"{name}: {seconds[name]:.3f}", file=sys.stderr, flush=True)
    parts = {"train_and_save_per_horizon"}
    line = {
        "metric": "total time of the headline jobs",
        "value": round(sum(v for k, v in seconds.items() if k not in parts), 3),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in seconds.items()},
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
