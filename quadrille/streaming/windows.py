"""Event-time windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if late else df


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; ``slide`` makes the windows overlap.  Works on batches and streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """Sessions of each user: runs of events with gaps below ``gap``."""
    got = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "n")
