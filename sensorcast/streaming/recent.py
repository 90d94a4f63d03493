"""A small table of every station's newest readings, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorcast.config import STATION, TIME
from sensorcast.operators import series
from sensorcast.operators.clean import keep_last
from sensorcast.schema import LANDED_AT, READING_SCHEMA, SOURCE_OFFSET
from sensorcast.sources import published

ROWS = 20
RECENT_SCHEMA = T.StructType(
    [*READING_SCHEMA.fields, T.StructField(LANDED_AT, T.TimestampType()), T.StructField(SOURCE_OFFSET, T.LongType())]
)


def merged(table: DataFrame, batch: DataFrame, rows: int = ROWS) -> DataFrame:
    """The newest ``rows`` readings per station of both, each in the version that landed last. Merging a batch
    again changes nothing."""
    arrived = batch.filter(F.col(STATION).isNotNull() & F.col(TIME).isNotNull()).select(RECENT_SCHEMA.names)
    both = keep_last(table.unionByName(arrived), [LANDED_AT, SOURCE_OFFSET, "pm25"])
    return series.recent(both, rows).select(RECENT_SCHEMA.names)


def merge_batch(batch: DataFrame, batch_id: int, path: str, run_id: str, rows: int = ROWS) -> None:
    """Publish the table with one micro-batch of readings in it. A batch that was published is left alone."""
    spark = batch.sparkSession
    if not published.is_published(spark, path, run_id, batch_id):
        published.publish_batch(merged(read_recent(spark, path), batch, rows), path, run_id, batch_id)


def recent_stream(
    readings: DataFrame, path: str, checkpoint: str, run_id: str, rows: int = ROWS, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the newest ``rows`` readings of each station, late ones and corrections included, at ``path``.

    Each micro-batch costs its own readings and the small table, however long the history is. ``run_id``
    belongs to the checkpoint, as batch numbers restart with a new one.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, batch_id, path, run_id, rows)

    writer = readings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was published last; empty before the first batch."""
    return published.read_newest(spark, path, RECENT_SCHEMA)
