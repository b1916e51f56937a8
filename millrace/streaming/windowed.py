"""Keyed monoid aggregation over event-time windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.monoids import Monoid, resolve


def windowed_group_aggregate(events: DataFrame, time: str, key: Column, value: Column, op: str | Monoid, width: str, lateness: str | None = None) -> DataFrame:
    """(window_start, key, value). Works on batch and streaming frames alike; ``lateness`` sets the watermark, which
    bounds the state a stream keeps. Rows without a time belong to no window."""
    timed = events.withWatermark(time, lateness) if events.isStreaming and lateness else events
    grouped = timed.groupBy(F.window(time, width).alias("w"), key.alias("key")).agg(resolve(op).over(value).alias("value"))
    return grouped.select(F.col("w.start").alias("window_start"), "key", "value")
