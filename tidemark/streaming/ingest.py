"""Continuous ingest of an operation log with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Store

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int | None = None) -> DataFrame:
    """The operations of event files as a stream; ``files`` bounds a micro-batch."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", name)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    return operations(reader.parquet(folder))


def operations(events: DataFrame) -> DataFrame:
    suffix = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("prefix"), suffix.alias("suffix"), (F.col("event_type") == "error").alias("is_delete"), "value")


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Start to append micro-batches to a store, flushing and compacting as it goes.

    A batch that is delivered again has its old id and changes nothing; late and
    out-of-order operations lose to newer ones by their sequence number.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)
        store.maintain()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, store: Store, checkpoint: str) -> Store:
    """Ingest all that is there and wait for it."""
    ingest(stream, store, checkpoint).awaitTermination()
    return store
