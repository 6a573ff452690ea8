"""Streaming counterparts (an extension): note counts in sliding windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, length: str = "1 day", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of events (ts, event_type, value), streaming or not. Windows align to the epoch."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    w = rows.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
