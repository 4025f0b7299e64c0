"""Event-time windows over streams and tables; beyond what drawings need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """Events with a watermark, which needs timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late`` a stream drops rows later than that."""
    own = _timed(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a user that end after a gap without events."""
    own = _timed(events, late)
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
