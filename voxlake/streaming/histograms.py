"""A histogram of values that arrive over time: counts add up, so a stream keeps one row a bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import bin_of


def streaming_histogram(stream: DataFrame, lo: float, hi: float, bins: int, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(bin, n), or by event-time window with a watermark.  Use ``complete`` or ``update`` output without a window, ``append`` with one."""
    b = bin_of(F.col("value"), lo, hi, bins).alias("bin")
    if time is None:
        return stream.groupBy(b).agg(F.count("*").alias("n"))
    return stream.withWatermark(time, late).groupBy(F.window(time, window), b).agg(F.count("*").alias("n"))
