import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensorcast.config import MEASURES  # noqa: E402
from sensorcast.schema import READING_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2024, 1, 1)


@pytest.fixture
def make_readings(spark):
    """Readings from {station: [(hours after the start, pm25), ...]}."""

    def make(series):
        rows = []
        for station, points in series.items():
            for hours, pm25 in points:
                other = [pm25 if m in ("pm25", "aqi") else float(hours % 7) for m in MEASURES]
                # Aware timestamps would be shifted by the host's zone; go through text instead.
                stamp = (START + timedelta(hours=hours)).isoformat()
                rows.append((station, station.title(), 1.0, 2.0, stamp, *other))
        text = READING_SCHEMA.fieldNames()
        schema = ", ".join(
            f"{n} {'string' if n in ('location_id', 'location_name', 'timestamp') else 'double'}" for n in text
        )
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("timestamp", df["timestamp"].cast("timestamp"))

    return make


def rows_of(df):
    """Rows as sorted tuples, timestamps as text."""
    from pyspark.sql import functions as F

    shown = df.select(
        *[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("timestamp", "date") else F.col(f"`{f.name}`") for f in df.schema]
    )
    return sorted((tuple(r) for r in shown.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
