"""Streams end in the rows of their batch forms, however the files fall into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from voltide.operators.bars import ticks_to_bars
from voltide.operators.features import add_log_return
from voltide.plans.series import Series
from voltide.streaming import live

HOURS = Series(step=3600)


@pytest.fixture
def ticks(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["A", "B", None]), 1_700_000_000 + rng.randrange(40 * 86400), float(rng.randrange(1, 99)), float(rng.randrange(5)), k) for k in range(1500)]
    return spark.createDataFrame(rows, "symbol string, t long, price double, size double, tick_id long").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


def stream(spark, df, path, files, per_trigger):
    """Rows in random order over ``files`` files."""
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def rows(df):
    return sorted(map(str, (tuple(r.asDict().items()) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("per_trigger", [1, 3, 1000])
def test_bars(spark, ticks, tmp_path, per_trigger):
    source = stream(spark, ticks, f"{tmp_path}/in", 5, per_trigger)
    assert rows(live.stream_bars(source, f"{tmp_path}/out", f"{tmp_path}/cp")) == rows(ticks_to_bars(ticks, 3600))


@pytest.mark.parametrize("per_trigger", [1, 3, 1000])
def test_dedup(spark, ticks, tmp_path, per_trigger):
    candles = ticks.select("symbol", F.unix_millis("timestamp").alias("open_time"), "price").dropDuplicates(["symbol", "open_time"])
    source = stream(spark, candles.union(candles).union(candles), f"{tmp_path}/in", 6, per_trigger)
    assert rows(live.stream_dedup(source, f"{tmp_path}/out", f"{tmp_path}/cp")) == rows(candles)


@pytest.mark.parametrize("per_trigger", [1, 1000])
def test_returns(spark, ticks, tmp_path, per_trigger):
    bars = ticks_to_bars(ticks.where("symbol IS NOT NULL"), 3600).select("symbol", "timestamp", "price_close", "num_trades")
    source = stream(spark, bars, f"{tmp_path}/in", 3, per_trigger)
    out = live.stream_log_return(source, f"{tmp_path}/out", f"{tmp_path}/cp", HOURS, ("num_trades", "price_close"))
    assert rows(out.select(*bars.columns, "log_return")) == rows(add_log_return(bars, HOURS))


def test_unknown_symbol_keeps_its_rows(spark):
    cuts = spark.createDataFrame([("A", 1.0, 2.0)], "symbol string, q33 double, q67 double")
    data = spark.createDataFrame([("A", 0.5), ("A", None), ("B", 0.5)], "symbol string, vol_60m double")
    got = {(r.symbol, r.vol_60m): r.regime for r in live.stream_threshold_regime(data, cuts).collect()}
    assert got == {("A", 0.5): 0, ("A", None): 2, ("B", 0.5): None}
