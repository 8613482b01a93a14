"""Bars of an event stream: watermarked windows, one row a finished bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """As ``barwright.sources.bars``, over a stream; events later than the watermark are dropped. ts must be a TIMESTAMP."""
    order = F.struct("ts", "event_id")
    binned = events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), F.col("event_type").alias("symbol"))
    return binned.agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume")
    ).select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
