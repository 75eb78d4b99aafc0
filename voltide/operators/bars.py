"""Roll ticks or finer bars up to OHLCV bars of any interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_start(time: Column, seconds: int) -> Column:
    """Start of the interval of ``seconds`` the time falls in, aligned to the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / F.lit(seconds)) * F.lit(seconds))


def ticks_to_bars(ticks: DataFrame, seconds: int = 3600) -> DataFrame:
    """``ticks(symbol, timestamp, price, size, tick_id)`` to bars; ties in time are broken by tick_id.

    All aggregates combine before the shuffle, so a hot symbol ships one row per bar and task.
    """
    order = F.struct("timestamp", "tick_id", "price")
    return (
        ticks.groupBy("symbol", bucket_start(F.col("timestamp"), seconds).alias("bar"))
        .agg(
            F.min_by("price", order).alias("price_open"),
            F.max("price").alias("price_high"),
            F.min("price").alias("price_low"),
            F.max_by("price", order).alias("price_close"),
            F.sum("size").alias("volume_base"),
            F.sum(F.col("price") * F.col("size")).alias("volume_quote"),
            F.count(F.lit(1)).alias("num_trades"),
        )
        .withColumnRenamed("bar", "timestamp")
    )


def ohlcv_bars(bars: DataFrame, seconds: int = 3600) -> DataFrame:
    """Finer bars to coarser bars, with the number of source bars."""
    return (
        bars.groupBy("symbol", bucket_start(F.col("timestamp"), seconds).alias("bar"))
        .agg(
            F.min_by("price_open", "timestamp").alias("price_open"),
            F.max("price_high").alias("price_high"),
            F.min("price_low").alias("price_low"),
            F.max_by("price_close", "timestamp").alias("price_close"),
            F.sum("volume_base").alias("volume_base"),
            F.sum("volume_quote").alias("volume_quote"),
            F.sum("num_trades").alias("num_trades"),
            F.count(F.lit(1)).alias("n_bars"),
        )
        .withColumnRenamed("bar", "timestamp")
    )
