"""Incremental ingest into the ledger, an extension: a stream of rows is deduplicated by id and counted by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import ledger


def daily_counts(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Documents by day and kind of a stream of events (event_id, ts, event_type, value, props); state older than the lateness is dropped."""
    fresh = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    rows = ledger(fresh)
    return rows.groupBy(F.window("saved_at", "1 day").alias("day"), "kind").agg(F.count("*").alias("documents")).select(F.col("day.start").alias("day"), "kind", "documents")
