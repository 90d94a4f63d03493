"""Landing live readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorcast.config import TIME
from sensorcast.operators.clean import decode_messages
from sensorcast.schema import DATE, LANDED_AT, READING_SCHEMA, REJECT, REJECTED_TEXT, SOURCE_POSITION

EVERY = {"processingTime": "5 seconds"}


def ingest_readings(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    dedupe_within: str | None = None,
    trigger: dict | None = None,
    source_zone: str | None = None,
) -> StreamingQuery:
    """Decode messages and append all of them to ``path``: readings, and rejects with their text and
    the reason, in folders of their own. ``read_landed`` and ``read_rejects`` tell them apart.

    It is one query with one set of offsets, so each message lands exactly once as the one or the
    other. Every row has the time of landing and, from Kafka, its partition and offset.
    ``dedupe_within`` also drops readings that equal, in all columns, one that arrived up to that
    delay before. The delay counts from arrival, so no reading is too late to land, however old it
    is; corrected versions land too, and readers use ``keep_last``. Its state grows with the delay.
    """
    decoded = decode_messages(messages, source_zone)
    bad = F.col(REJECT).isNotNull()
    position = [
        (F.col(own) if own in messages.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for own, field in zip(("partition", "offset"), SOURCE_POSITION)
    ]
    landed = decoded.select(
        *READING_SCHEMA.names,
        F.when(bad, F.col("value")).alias(REJECTED_TEXT),
        *position,
        F.current_timestamp().alias(LANDED_AT),
        REJECT,
        F.to_date(TIME).alias(DATE),
    )
    if dedupe_within is not None:
        # Every reject counts, also one with the text of another.
        keyed = landed.withColumn("_own", F.when(F.col(REJECT).isNotNull(), F.uuid()))
        unique = keyed.withWatermark(LANDED_AT, dedupe_within)
        landed = unique.dropDuplicatesWithinWatermark([*READING_SCHEMA.names, "_own"]).drop("_own")
    writer = landed.writeStream.format("parquet").outputMode("append").trigger(**(trigger or EVERY))
    return writer.partitionBy(REJECT, DATE).option("path", path).option("checkpointLocation", checkpoint).start()
