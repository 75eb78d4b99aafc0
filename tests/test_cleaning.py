import pandas as pd
from pyspark.sql import functions as F

from voltide.operators import bars as B
from voltide.operators import cleaning as C
from voltide.operators import summaries as A
from voltide.plans.series import Series
from voltide.sources import tables
from voltide.sources.klines import decode_kline_json


def test_epoch_units_agree(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,)], "e long")
    out = {r["t"] for r in df.select(C.epoch_to_timestamp(F.col("e")).alias("t")).collect()}
    assert len(out) == 1


def test_valid_candles(spark):
    rows = [(1.0, 2.0, 0.5, 1.5), (0.0, 2.0, 0.5, 1.5), (1.0, 0.4, 0.5, 0.45), (1.0, 2.0, 0.5, 3.0)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double")
    assert C.valid_candles(df).count() == 1
    assert C.valid_candles(df, strict=False).count() == 2


def test_dedup_keeps_the_newest(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 2), ("A", 1, 6.0, 3), ("A", 2, 7.0, 1)], "symbol string, t int, close double, seen int")
    for order in ("seen", "close"):
        out = C.dedup_bars(df.orderBy(order), ["symbol", "t"], ["seen"]).orderBy("t").collect()
        assert [r["close"] for r in out] == [6.0, 7.0]


def test_ties_in_time_are_broken_by_id(spark):
    df = spark.createDataFrame([("A", 10, 3.0, 1.0, 7), ("A", 10, 4.0, 1.0, 9), ("A", 10, 5.0, 1.0, 8)],
                               "symbol string, s long, price double, size double, tick_id long")
    bar = B.ticks_to_bars(df.withColumn("timestamp", F.timestamp_seconds("s")), 60).first()
    assert (bar["price_open"], bar["price_close"], bar["num_trades"]) == (3.0, 4.0, 3)


def test_gap_report_and_plan(make):
    at = [0, 1, 2, 6, 7, 8, 9]
    pdf = pd.DataFrame({"symbol": "X", "timestamp": [1_700_000_040 + 60 * i for i in at], "price_close": 1.0, "volume_base": 1.0})
    s = Series(step=60, chunk_rows=16)
    report = A.quality_report(make(pdf), s).first()
    assert (report["n_gaps"], report["missing_rows"]) == (1, 3) and abs(report["pct_missing"] - 30) < 1e-9
    pages = tables.backfill_plan(make(pdf), s, page=2).orderBy("page_start").collect()
    assert [p["n_candles"] for p in pages] == [2, 1]


def test_range_pages_cover_the_days(spark):
    pages = tables.range_pages(spark, "2026-01-01", "2026-01-02").orderBy("start_ms").collect()
    assert pages[0]["start_ms"] == 1767225600000 and len(pages) == 3
    assert all(b["start_ms"] > a["end_ms"] for a, b in zip(pages, pages[1:])) and pages[-1]["end_ms"] == 1767398399000


def test_decode_json_with_a_bad_number(spark):
    df = spark.createDataFrame([('[[1700000000000,"1.5","2","1","x","9",1700000059999,"13.5",4,"0","0","0"]]',)], "value string")
    row = decode_kline_json(df).first()
    assert row["open"] == 1.5 and row["close"] is None and row["trades"] == 4


def test_staged_consolidation_and_params(spark, tmp_path, make):
    pdf = pd.DataFrame({"symbol": "X", "timestamp": [1_700_000_000 // 3600 * 3600 + 3600 * i for i in (0, 1, 1, 2)],
                        "price_close": [1.0, 2.0, 4.0, 8.0], "num_trades": [1, 1, 2, 1], "log_return": [None] * 4})
    df = C.calendar_columns(make(pdf.astype({"log_return": float})))
    raw, clean = str(tmp_path / "raw"), str(tmp_path / "clean")
    assert tables.append_bars(df, raw) and not tables.append_bars(df.limit(0), raw)
    assert tables.consolidate(spark, raw, clean, Series(), ["num_trades"]).first()["n"] == 3
    returns = [r["log_return"] for r in tables.scan_bars(spark, clean, ["X"], "2023-01-01", "2024-01-01").orderBy("timestamp").collect()]
    assert returns[0] is None and abs(returns[1] - 1.3862943611) < 1e-9
