"""The whole chain through the command line."""

import math

import pytest
from pyspark.sql import functions as F

from sensorcast.__main__ import main
from sensorcast.sources import readers, writers


def test_from_history_to_report(spark, make_readings, tmp_path):
    path = lambda name: str(tmp_path / name)
    source = make_readings({s: [(h, 30 + 20 * math.sin((h + i) / 4)) for h in range(80)] for i, s in enumerate(("hanoi", "hcm"))})
    writers.write_csv(source, path("history"))
    writers.to_messages(source).select("value").write.text(path("inbox"))

    main(["train", "--history", path("history"), "--models", path("models"), "--horizons", "1", "3"])
    main(["ingest", "--source", "json", "--path", path("inbox"), "--landed", path("landed"), "--state", path("s0"),
          "--dedupe-within", "10 days", "--once"])
    main(["compact", "--landed", path("landed"), "--compacted", path("compacted"), "--min-files", "1"])
    main(["features", "--landed", path("landed"), "--features", path("features"), "--state", path("s1"), "--run", "r", "--once",
          "--compacted", path("compacted"), "--max-files", "50"])
    main(["score", "--features", path("features"), "--models", path("models"), "--forecasts", path("forecasts"),
          "--state", path("s2"), "--once"])
    main(["report", "--landed", path("landed"), "--forecasts", path("forecasts"), "--target", path("report"), "--horizon", "3",
          "--compacted", path("compacted")])

    assert readers.read_landed(spark, path("landed")).count() == source.count()
    assert spark.read.parquet(path("forecasts")).count() == 2 * 77 * 2
    detail = spark.read.parquet(path("report") + "/detail")
    assert [r.status for r in detail.collect()] == ["ready", "ready"]
    overview = spark.read.parquet(path("report") + "/overview")
    assert {r.location_id: r.region_iso for r in overview.collect()} == {"hanoi": "VN-HN", "hcm": "VN-SG"}
    assert spark.read.parquet(path("report") + "/recent").groupBy("location_id").count().agg(F.max("count")).first()[0] == 20


def test_one_hour_model_and_sensor_file(spark, make_readings, tmp_path, capsys):
    path = lambda name: str(tmp_path / name)
    writers.write_csv(make_readings({"a": [(h, float(h % 9)) for h in range(60)]}), path("history"))
    main(["train-one-hour", "--history", path("history"), "--models", path("models"), "--step", "rows"])
    assert "rmse" in capsys.readouterr().out
    (tmp_path / "s.csv").write_text("Date;Time;CO;;\n10/03/2004;18.00.00;2,6;;\n")
    main(["clean-sensor", "--source", path("s.csv"), "--target", path("clean"), "--measures", "co"])
    assert spark.read.parquet(path("clean")).first().co == 2.6


def test_unknown_job():
    with pytest.raises(SystemExit):
        main(["dance"])
