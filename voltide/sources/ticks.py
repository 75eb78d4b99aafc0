"""Tick adapters: any table with a symbol, a time, a price, a size and a tie-break."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_ticks(df: DataFrame) -> DataFrame:
    """Events as ticks: type is the symbol, value the price, ``props.k`` the size; free ticks are dropped."""
    return df.where(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("tick_id"),
    )


def read_event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: unit price per return flag, many ticks per day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.where((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0)).select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tick_id"),
    )
