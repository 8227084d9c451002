"""Event-time aggregates that run alike over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, size: str, aggregates: list[Column], keys: list[str] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding windows; on a stream rows later than ``late`` are dropped."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.window(time, size, slide or size), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *(c for c in out.columns if c not in ("window", *keys)))


def sessions(events: DataFrame, time: str, gap: str, aggregates: list[Column], keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Windows that end when a key is silent for the gap."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *keys, *(c for c in out.columns if c not in ("session_window", *keys)))


def joined(left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows that meet the SQL condition ``on`` and whose times lie within the interval; on streams the state of each side is dropped behind the watermark."""
    if left.isStreaming:
        left = left.withWatermark(left_time, late)
    if right.isStreaming:
        right = right.withWatermark(right_time, late)
    return left.join(right, F.expr(f"({on}) AND {left_time} BETWEEN {right_time} - INTERVAL {within} AND {right_time} + INTERVAL {within}"))
