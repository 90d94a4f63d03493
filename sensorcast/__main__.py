"""Run the library's jobs: python -m sensorcast <job> ..., or through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sensorcast.config import HORIZONS, FeatureConfig, ForestConfig
from sensorcast.functions.stations import station_dimension
from sensorcast.plans import reports, training
from sensorcast.sources import compaction, readers, streams, writers
from sensorcast.streaming.forecast import feature_stream, score_stream
from sensorcast.streaming.ingest import ingest_readings


def _history(spark, args):
    if args.format == "csv":
        return readers.read_readings_csv(spark, args.history, args.zone)
    return readers.read_readings_parquet(spark, args.history)


def _config(args) -> FeatureConfig:
    return FeatureConfig(step=args.step, tolerance_minutes=args.tolerance if args.step == "hours" else 0)


def _trigger(args) -> dict:
    return {"availableNow": True} if args.once else {"processingTime": args.every}


def _wait(queries) -> None:
    for query in queries:
        query.awaitTermination()


def clean_sensor(spark, args):
    """One station's sensor file to Parquet."""
    writers.write_table(readers.read_sensor_csv(spark, args.source, args.measures), args.target)


def train_one_hour(spark, args):
    """The next-step model; prints its hold-out metrics."""
    model, quality = training.one_hour_model(_history(spark, args), _config(args))
    training.save_models(spark, {1: model}, args.models)
    quality.show(truncate=False)


def train(spark, args):
    """A model per horizon; prints the hold-out metrics."""
    config, horizons = _config(args), args.horizons or HORIZONS
    table = training.training_table(_history(spark, args), config, horizons)
    estimator = training.forest(ForestConfig())
    models = training.train_horizons(table, config, horizons, estimator, parallelism=args.parallelism)
    training.save_models(spark, models, args.models, args.parallelism)
    training.holdout_metrics(table, models).orderBy("horizon_hours").show(len(horizons), truncate=False)


def ingest(spark, args):
    """Messages from Kafka, or from a folder of text files, to landed readings."""
    options = dict(o.split("=", 1) for o in args.option)
    source = streams.message_stream(spark, args.source, args.path, **options)
    _wait([ingest_readings(source, args.landed, args.state, args.dedupe_within, _trigger(args), args.zone)])


def compact(spark, args):
    """Small files of landed readings and rejects to large ones, in a table beside them."""
    done = compaction.compact(spark, args.landed, args.compacted, rows_per_file=args.rows_per_file, min_files=args.min_files)
    print(f"{len(done)} folders rewritten")


def _landed(spark, args):
    if args.compacted:
        return readers.accepted_rows(compaction.read_compacted(spark, args.landed, args.compacted))
    return readers.read_landed(spark, args.landed)


def features(spark, args):
    """Landed readings to feature rows."""
    options = {"maxFilesPerTrigger": str(args.max_files)} if args.max_files else {}
    source = streams.reading_stream(spark, args.landed, **options)
    history = lambda session: _landed(session, args)
    lookback = args.lookback or None if args.step == "hours" else None
    _wait([feature_stream(source, history, args.features, args.state, args.run, _config(args), lookback, _trigger(args))])


def score(spark, args):
    """Feature rows to forecasts."""
    models = training.load_models(spark, args.models, args.horizons)
    _wait([score_stream(spark, args.features, models, args.forecasts, args.state, _config(args), _trigger(args))])


def report(spark, args):
    """The overview and detail tables of all stations."""
    landed = _landed(spark, args)
    forecasts = readers.read_forecasts(spark, args.forecasts)
    writers.write_table(reports.station_overview(landed, station_dimension(spark)), f"{args.target}/overview")
    writers.write_table(reports.station_detail(landed, forecasts, args.horizon), f"{args.target}/detail")
    writers.write_table(reports.recent_readings(landed), f"{args.target}/recent")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sensorcast", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    def job(run, *required):
        one = jobs.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        one.set_defaults(start=run)
        for name in required:
            one.add_argument(f"--{name}", required=True)
        return one

    def training_options(one):
        one.add_argument("--format", choices=("csv", "parquet"), default="csv")
        one.add_argument("--zone", help="time zone of timestamps without offset")
        one.add_argument("--step", choices=("rows", "hours"), default="hours")
        one.add_argument("--tolerance", type=float, default=0, help="minutes a reading may be off the hour, for --step hours")

    def streaming_options(one):
        one.add_argument("--once", action="store_true", help="process what is there and stop")
        one.add_argument("--every", default="5 seconds")

    one = job(clean_sensor, "source", "target")
    one.add_argument("--measures", nargs="+", required=True)

    training_options(job(train_one_hour, "history", "models"))

    one = job(train, "history", "models")
    training_options(one)
    one.add_argument("--horizons", nargs="+", type=int)
    one.add_argument("--parallelism", type=int, default=4)

    one = job(ingest, "landed", "state")
    streaming_options(one)
    one.add_argument("--source", choices=("kafka", "json"), default="kafka")
    one.add_argument("--path", help="folder of text files, for --source json")
    one.add_argument("--option", action="append", default=[], help="name=value for the source")
    one.add_argument("--dedupe-within")
    one.add_argument("--zone", help="time zone of timestamps without offset")

    one = job(compact, "landed", "compacted")
    one.add_argument("--rows-per-file", type=int, default=compaction.ROWS_PER_FILE)
    one.add_argument("--min-files", type=int, default=2, help="files a folder must have before it is rewritten")

    one = job(features, "landed", "features", "state", "run")
    streaming_options(one)
    one.add_argument("--compacted", help="table of the compact job, to read history from")
    one.add_argument("--max-files", type=int, help="landed files a micro-batch takes at most")
    one.add_argument("--step", choices=("rows", "hours"), default="hours")
    one.add_argument("--tolerance", type=float, default=0, help="minutes a reading may be off the hour, for --step hours")
    one.add_argument("--lookback", type=int, default=24, help="hours of history for --step hours; 0 for all")

    one = job(score, "features", "models", "forecasts", "state")
    streaming_options(one)
    one.add_argument("--step", choices=("rows", "hours"), default="hours")
    one.add_argument("--tolerance", type=float, default=0, help="minutes a reading may be off the hour, for --step hours")
    one.add_argument("--horizons", nargs="+", type=int)

    one = job(report, "landed", "forecasts", "target")
    one.add_argument("--compacted", help="table of the compact job, to read history from")
    one.add_argument("--horizon", type=int, default=1)
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    builder = SparkSession.builder.appName(f"sensorcast {args.job}")
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    args.start(spark, args)


if __name__ == "__main__":
    main()
