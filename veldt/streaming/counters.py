"""Streaming forms of the associative summaries. They go beyond what batch use needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, by: list[str], value: str, time: str | None = None, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by key, in event-time windows with a watermark where a time is given."""
    aggregates = (F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    if time is None:
        return stream.groupBy(*by).agg(*aggregates)
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(*aggregates)
