"""Answer logs as streams: an extension for logs that are still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_accounting(stream: DataFrame, time: str, key: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Lines, errors and mean latency by window, each line counted once; lines later than the watermark
    are dropped, as the state must end somewhere."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, window)).agg(F.count("*").alias("lines"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.avg("latency_s").alias("mean_latency")).select("window.start", "window.end", "lines", "errors", "mean_latency")


def last_wins(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The latest line of each key so far (complete or update mode)."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")
