import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sensorcast.operators import clean
from sensorcast.plans import reports, storage
from sensorcast.functions.stations import station_dimension
from sensorcast.schema import READING_SCHEMA
from sensorcast.sources import readers, streams, writers
from sensorcast.staging import shared_dir, stage


@pytest.fixture
def sample(make_readings):
    return make_readings({"hanoi": [(0, 1.5), (1, 2.5)], "hcm": [(0, 30.0)]})


def test_csv_keeps_readings(spark, sample, tmp_path):
    writers.write_csv(sample, str(tmp_path / "csv"))
    back = readers.read_readings_csv(spark, str(tmp_path / "csv"))
    assert back.schema == READING_SCHEMA
    assert rows_of(back) == rows_of(sample)


def test_malformed_csv_values_become_null(spark, tmp_path):
    file = tmp_path / "r.csv"
    file.write_text(",".join(READING_SCHEMA.names) + "\na,A,1,2,2024-01-01T00:00,5,,x,4,5,6,7\nb,B,1,2,never,1\n")
    rows = rows_of(readers.read_readings_csv(spark, str(file)).select("location_id", "timestamp", "pm25", "pm10", "co", "aqi"))
    assert rows == [("a", "2024-01-01 00:00:00", 5.0, None, None, 7.0), ("b", None, 1.0, None, None, None)]


def test_csv_with_other_columns_is_an_error(spark, tmp_path):
    file = tmp_path / "r.csv"
    names = READING_SCHEMA.names
    file.write_text(",".join(reversed(names)) + "\n" + ",".join("1" for _ in names) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_readings_csv(spark, str(file)).collect()


def test_local_history_is_moved_to_utc(spark, tmp_path):
    file = tmp_path / "r.csv"
    file.write_text(",".join(READING_SCHEMA.names) + "\na,A,1,2,2024-01-01T07:00,5,1,1,4,5,6,7\n")
    row = readers.read_readings_csv(spark, str(file), source_zone="Asia/Bangkok").select(F.col("timestamp").cast("string"))
    assert row.first()[0] == "2024-01-01 00:00:00"


def test_sensor_file(spark, tmp_path):
    file = tmp_path / "s.csv"
    file.write_text("Date;Time;CO;NO2;;\n10/03/2004;18.00.00;2,6;-200;;\n;;;;;\n")
    rows = rows_of(readers.read_sensor_csv(spark, str(file), ["co", "no2"]).select("timestamp", "co", "no2"))
    assert rows == [("2004-03-10 18:00:00", 2.6, None)]


def test_parquet_replaces(spark, sample, tmp_path):
    path = str(tmp_path / "p")
    writers.write_table(sample, path)
    writers.write_table(sample.filter("location_id = 'hcm'"), path)
    assert rows_of(readers.read_readings_parquet(spark, path)) == rows_of(sample.filter("location_id = 'hcm'"))


def test_batch_replay_replaces_itself_only(spark, sample, tmp_path):
    path = str(tmp_path / "b")
    writers.write_batch(sample, path, "r1", 0)
    writers.write_batch(sample.limit(1), path, "r1", 1)
    writers.write_batch(sample, path, "r2", 0)
    writers.write_batch(sample.filter("location_id = 'hcm'"), path, "r1", 0)
    counts = spark.read.parquet(path).groupBy("run_id", "batch_id").count()
    assert rows_of(counts) == [("r1", 0, 1), ("r1", 1, 1), ("r2", 0, 3)]


def test_messages_keep_readings(spark, sample):
    messages = writers.to_messages(sample)
    assert sorted(r.key for r in messages.collect()) == ["hanoi", "hanoi", "hcm"]
    assert rows_of(clean.accepted(clean.decode_messages(messages.select("value")))) == rows_of(sample)


def test_payload_with_missing_values(spark):
    hourly = {"time": ["2024-01-01T07:00", "2024-01-01T08:00"], "pm2_5": [1.0, None], "european_aqi": [3, 4]}
    df = spark.createDataFrame([("a", json.dumps({"hourly": hourly})), ("b", "{}"), ("c", "oops")], "location_id string, p string")
    rows = readers.flatten_payload(df, F.col("p"), ["location_id"], "Asia/Bangkok")
    assert rows_of(rows.select("location_id", "timestamp", "pm25", "pm10", "aqi")) == [
        ("a", "2024-01-01 00:00:00", 1.0, None, 3.0),
        ("a", "2024-01-01 01:00:00", None, None, 4.0),
    ]


def test_regions_and_overlay(spark, sample, tmp_path):
    file = tmp_path / "map.geojson"
    shapes = [{"type": "Feature", "properties": {"shapeISO": c}, "geometry": {"type": "Point", "coordinates": [1, 2]}} for c in ("VN-HN", "VN-SG", "VN-XX")]
    file.write_text(json.dumps({"type": "FeatureCollection", "features": shapes}, indent=1))
    regions = readers.read_regions(spark, str(file))
    overview = reports.station_overview(sample, station_dimension(spark))
    overlay = reports.region_overlay(regions, overview).select("region_iso", "aqi")
    assert rows_of(overlay) == [("VN-HN", 2.5), ("VN-SG", 30.0), ("VN-XX", 0.0)]


def test_unknown_message_source(spark):
    with pytest.raises(ValueError):
        streams.message_stream(spark, "carrier pigeon")


def test_staging_uses_the_shared_folder(spark, sample):
    staged = stage(sample, "t")
    assert all(f.removeprefix("file://").startswith(shared_dir(spark)) for f in staged.inputFiles())
    assert rows_of(staged) == rows_of(sample)


def test_format_comparison(sample):
    rows = {r.format: r for r in storage.compare_formats(sample, "pm25").collect()}
    assert set(rows) == {"csv", "parquet"}
    assert all(r.bytes > 0 and r.files > 0 and r.scan_seconds > 0 for r in rows.values())
