"""Trends over an unbounded input.

Row-local operators (filters, coercion, indicators, arithmetic features, question tags, scoring) need
nothing from here: they are plain expressions and run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.aggregate import measure

# Window length and offset of the grains that have a fixed length; weeks start on Monday.
WINDOWS = {"1d": ("1 day", "0 days"), "1w": ("7 days", "4 days")}


def stream_trend(df: DataFrame, time: str, metric: str, agg: str = "sum", grain: str = "1d", late: str = "1 day") -> DataFrame:
    """Metric per day or week; a bucket is final once the watermark has passed it."""
    if grain not in WINDOWS:
        raise ValueError("a stream can close day and week buckets only")
    length, offset = WINDOWS[grain]
    timed = df.select(col(time).cast("timestamp").alias("__time"), col(metric)).where(col(metric).isNotNull())
    buckets = F.window("__time", length, startTime=offset)
    grouped = timed.withWatermark("__time", late).groupBy(buckets.alias("w")).agg(measure(metric, agg).alias(metric))
    return grouped.select(F.to_date("w.start").alias(time), col(metric))
