"""Bars of a stream of ticks, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, time: str = "ts", entity: str = "symbol", price: str = "price", volume: str = "volume", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """open, high, low, close, volume of each entity and window; works alike on a stream and a table.

    State is one row for each entity and open window. Ticks later than the watermark are dropped from a stream.
    """
    source = ticks.withWatermark(time, late) if ticks.isStreaming else ticks
    order = F.col(time)
    return (
        source.groupBy(F.window(time, width).alias("w"), F.col(entity))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("n_ticks"))
        .select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "n_ticks")
    )
