"""Live versions of ingestion, bars, returns and labels; each ends in the same rows as its batch form.

Files may come in any order and any number may make a micro-batch. So nothing here drops a row for being late: every micro-batch
writes its own folder, which a repetition overwrites, and what belongs together over batches is joined or merged by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators.bars import bucket_start
from voltide.operators.cleaning import calendar_columns, canonical_bars, epoch_to_timestamp, valid_candles
from voltide.operators.regime_rules import regime_of, regime_name
from voltide.plans.series import Series
from voltide.sources.tables import PARTITIONS
from voltide.streaming.repair import late_repair
from voltide.streaming.runs import run_batches, run_to_parquet

CANDLE = ("symbol", "open_time")


def stream_ingest(candles: DataFrame, path: str, checkpoint: str, seconds: int | None = None,
                  trigger_seconds: int | None = None) -> None:
    """Candle stream to the bar table. The live filter is the loose one; returns stay NULL until repaired."""
    bars = canonical_bars(valid_candles(candles, strict=False))
    run_to_parquet(bars, path, checkpoint, PARTITIONS, seconds=seconds, trigger_seconds=trigger_seconds)


def _make_table(spark: SparkSession, schema: T.StructType, path: str, partitions: tuple[str, ...]) -> None:
    """An empty table, so that the first micro-batch finds one to read."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)


def stream_dedup(candles: DataFrame, path: str, checkpoint: str, **run: int) -> DataFrame:
    """One candle per symbol and open time across polls, however late its copies come; returns the table.

    A micro-batch keeps what is new in itself and against the months it touches. Of different candles for one key
    in a micro-batch the smallest in column order stays.
    """
    spark = candles.sparkSession
    schema = T.StructType([*candles.schema, T.StructField("batch", T.LongType()), T.StructField("open_month", T.StringType())])
    _make_table(spark, schema, path, ("batch", "open_month"))
    rest = [c for c in candles.columns if c not in CANDLE]

    def add(rows: DataFrame, batch: int) -> None:
        month = F.coalesce(F.date_format(epoch_to_timestamp(F.col("open_time")), "yyyy-MM"), F.lit("none"))
        single = rows.groupBy(*CANDLE).agg(F.min(F.struct(*rest)).alias("_rest")).select(*CANDLE, "_rest.*").withColumn("open_month", month)
        earlier = rows.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") < batch).select(*CANDLE, "open_month")
        known = earlier.join(single.select("open_month").distinct(), "open_month", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in CANDLE])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CANDLE]
        new = single.join(known, same[0] & same[1], "left_anti")
        new.write.mode("overwrite").partitionBy("open_month").parquet(f"{path}/batch={batch}")

    run_batches(candles, add, checkpoint, **run)
    return spark.read.schema(schema).parquet(path).drop("batch", "open_month")


TICK = "struct<timestamp: timestamp, tick_id: bigint, price: double>"
PARTIAL = (
    f"symbol string, timestamp timestamp, first {TICK}, last {TICK}, price_high double, price_low double, volume_base double, "
    "volume_quote double, num_trades long, batch long"
)


def stream_bars(ticks: DataFrame, path: str, checkpoint: str, seconds_per_bar: int = 3600, **run: int) -> DataFrame:
    """OHLCV bars of a tick stream; returns all bars, the open ones as far as they have come.

    A micro-batch adds one partial bar per symbol and interval that it has ticks of; reading merges them. Ticks may
    be late by any time, and a hot symbol is combined before it is shuffled.
    """
    spark = ticks.sparkSession
    schema = T.StructType.fromDDL(PARTIAL)
    _make_table(spark, schema, path, ("batch",))
    tick = F.struct("timestamp", F.col("tick_id").cast("long").alias("tick_id"), "price")

    def add(rows: DataFrame, batch: int) -> None:
        partial = rows.groupBy("symbol", bucket_start(F.col("timestamp"), seconds_per_bar).alias("bar")).agg(
            F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("price").alias("price_high"), F.min("price").alias("price_low"),
            F.sum("size").alias("volume_base"), F.sum(F.col("price") * F.col("size")).alias("volume_quote"), F.count(F.lit(1)).alias("num_trades"),
        )
        partial.withColumnRenamed("bar", "timestamp").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    run_batches(ticks, add, checkpoint, **run)
    return spark.read.schema(schema).parquet(path).groupBy("symbol", "timestamp").agg(
        F.min("first")["price"].alias("price_open"), F.max("price_high").alias("price_high"), F.min("price_low").alias("price_low"),
        F.max("last")["price"].alias("price_close"), F.sum("volume_base").alias("volume_base"), F.sum("volume_quote").alias("volume_quote"),
        F.sum("num_trades").alias("num_trades"),
    )


def stream_log_return(bars: DataFrame, path: str, checkpoint: str, s: Series, newest: tuple[str, ...], **run: int) -> DataFrame:
    """Bar table whose log returns are right after every micro-batch; returns the table.

    Bars are merged into the months they fall in, and only those and the month after are computed anew, in chunks,
    so neither a late bar nor a hot symbol needs state.
    """
    full = calendar_columns(bars.withColumn("log_return", F.lit(None).cast("double")), s.time)
    _make_table(bars.sparkSession, full.schema, path, PARTITIONS)
    run_batches(full, late_repair(path, s, newest, full.schema), checkpoint, **run)
    return bars.sparkSession.read.schema(full.schema).parquet(path)


def stream_threshold_regime(features: DataFrame, thresholds: DataFrame, value: str = "vol_60m") -> DataFrame:
    """Label live rows with stored cut points (one row per symbol, static side of the join).

    A symbol without cut points keeps its rows; they have no label.
    """
    cuts = thresholds.withColumn("_known", F.lit(True))
    out = features.join(cuts, "symbol", "left").withColumn("regime", F.when(F.col("_known"), regime_of(F.col(value))))
    return out.withColumn("regime_name", regime_name(F.col("regime"))).drop("q33", "q67", "_known")
