"""Structured Streaming over the same functions (an extension; the batch model has no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.events import with_identity


def new_events(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Events not seen before within the watermark, by fingerprint."""
    return with_identity(stream.withWatermark("retrieved_at", delay), "title", "event_category", "geo_country").dropDuplicatesWithinWatermark(["fingerprint"])


def counts(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is written once, to a folder named by it, so a repeated batch replaces itself."""
    return stream.writeStream.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/batch={number}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
