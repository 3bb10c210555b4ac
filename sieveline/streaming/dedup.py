"""Streams: keep-first deduplication by content and running accuracy, both bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_content(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose content wasn't seen within the delay; state older than the watermark is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_accuracy(stream: DataFrame, ts: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(window, n, accuracy) of a stream of (ts, y, p)."""
    hit = (F.col("y") == F.col("p")).cast("double")
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))
