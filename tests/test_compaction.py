from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.schema import DATE
from sensorcast.sources import compaction, published, readers, streams, writers
from sensorcast.streaming.ingest import ingest_readings

ONCE = {"availableNow": True}


class Landing:
    """A folder in which messages land, and its compacted table."""

    def __init__(self, spark, root):
        self.spark = spark
        self.inbox, self.landed, self.state, self.path = (str(root / n) for n in ("inbox", "landed", "state", "compacted"))

    def land(self, rows, text=None):
        messages = writers.to_messages(rows).select("value")
        if text is not None:
            messages = messages.unionByName(self.spark.createDataFrame([(text,)], "value string"))
        messages.repartition(4).write.mode("append").text(self.inbox)
        ingest_readings(streams.message_stream(self.spark, "json", self.inbox), self.landed, self.state, trigger=ONCE).awaitTermination()

    def compact(self, **options):
        return compaction.compact(self.spark, self.landed, self.path, **options)

    def read(self):
        return compaction.read_compacted(self.spark, self.landed, self.path)

    def same(self):
        """The compacted table holds what has landed; returns the number of files a reader opens."""
        whole = self.spark.read.schema(compaction.LANDED_OR_REJECTED).parquet(self.landed)
        assert rows_of(self.read()) == rows_of(whole)
        return len(self.read().inputFiles())


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def test_compacting_as_readings_land(spark, make_readings, landing):
    landing.land(make_readings({"a": [(h, float(h)) for h in range(48)], "b": [(h, 1.5) for h in range(30)]}), "<broken")
    before = landing.same()
    assert before > 3
    done = landing.compact()
    assert len(done) == 2 and landing.same() == 3  # two dates; the single reject's file stays
    assert landing.compact() == [] and landing.same() == 3

    # A late reading, one file: below the bound its file is read beside the compacted ones, then the date is rewritten.
    landing.land(make_readings({"late": [(5, 9.0)]}))
    assert landing.compact() == [] and landing.same() == 4
    assert any(folder.endswith("2024-01-01") for folder in landing.compact(min_files=1))
    assert landing.same() == 3
    accepted = readers.accepted_rows(landing.read())
    assert accepted.count() == 79 and accepted.filter("location_id = 'late'").count() == 1


def test_files_of_stated_size(spark, make_readings, landing):
    landing.land(make_readings({"a": [(h / 100, float(h)) for h in range(2000)], "b": [(30, 1.0)]}))
    landing.compact(rows_per_file=250, min_files=1)
    sizes = landing.read().groupBy(DATE, F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 2001 and max(r["count"] for r in sizes) < 600 and len(sizes) >= 5
    landing.same()
    # Files are cut by time: no two of one date overlap by more than their ends.
    spans = landing.read().groupBy(DATE, F.input_file_name().alias("f")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    spans = sorted((r["a"], r["b"]) for r in spans.collect())
    assert all(end <= start for (_, end), (start, _) in zip(spans, spans[1:]))


def test_a_compaction_that_dies_or_comes_second(spark, make_readings, landing, monkeypatch):
    landing.land(make_readings({"a": [(h, float(h)) for h in range(24)]}))
    commit = published.commit

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(published, "commit", die)
    with pytest.raises(RuntimeError):
        landing.compact()
    landing.same()

    # Another one starts and ends while this one is about to commit.
    def overtaken(*place):
        monkeypatch.setattr(published, "commit", commit)
        landing.compact()
        commit(*place)

    monkeypatch.setattr(published, "commit", overtaken)
    landing.compact()
    assert landing.same() == 1


def test_filters_reach_the_folders(spark, make_readings, landing):
    landing.land(make_readings({"a": [(h, float(h)) for h in range(72)]}))
    landing.compact()
    plan = landing.read().filter(F.col(DATE) == "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "reading_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_has_landed(spark, tmp_path):
    missing, path = str(tmp_path / "missing"), str(tmp_path / "compacted")
    assert compaction.compact(spark, missing, path) == []
    assert compaction.read_compacted(spark, missing, path).count() == 0
    assert not Path(path).exists()


def test_tables_of_any_partitions(spark, tmp_path):
    landed, path = str(tmp_path / "landed"), str(tmp_path / "compacted")
    rows = spark.createDataFrame([(1, "x y"), (2, "a:b"), (3, None), (4, "x y")], "n long, kind string")
    for _ in range(2):
        rows.write.mode("append").partitionBy("kind").parquet(landed)
    options = dict(schema=rows.schema, partition_by=["kind"])
    assert len(compaction.compact(spark, landed, path, sort_by="n", **options)) == 3
    found = compaction.read_compacted(spark, landed, path, **options)
    assert rows_of(found) == rows_of(rows.unionByName(rows)) and len(found.inputFiles()) == 3
