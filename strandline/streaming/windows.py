"""Event-time windows over an event stream, the same expressions for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Events with ``ts`` as an instant: watermarks need one, and the tables hold local times."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total): counts and sums per window and type."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with gaps below ``gap``."""
    rows = timed(events)
    if late:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
