"""Counts, ranges and data-quality reports of a bar or feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.plans.series import Series, over_series


def partition_counts(df: DataFrame, by: Sequence[str] = ("symbol", "year", "month")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by)


def describe_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count / mean / sample deviation / min / max per column, long form, in one pass."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(*by, stacked.alias("_s")).select(*by, "_s.column", "_s.v")
    return long.groupBy(*by, "column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )


def date_range(df: DataFrame, by: Sequence[str] = ("symbol",), time: str = "timestamp") -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(time).alias("first_bar"), F.max(time).alias("last_bar"), F.count(F.lit(1)).alias("n")
    )


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column and their share, only columns that have some, from one aggregate."""
    counts = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *counts)
    long = one.unpivot(["_n"], list(columns), "column", "n_null")
    return (
        long.where(F.col("n_null") > 0)
        .select("column", "n_null", (100.0 * F.col("n_null") / F.col("_n")).alias("pct_null"))
        .orderBy(F.desc("n_null"), "column")
    )


def quality_report(bars: DataFrame, s: Series, min_price: float = 0.0, max_change_pct: float = 50.0,
                   min_volume: float = 0.0, max_gaps: int = 10) -> DataFrame:
    """Per symbol: temporal gaps against the grid and breaches of the price, change and volume limits."""

    def build(d, f):
        return d.withColumns(
            {"_prev_time": F.lag(s.time, 1).over(f.ordered), "_prev_close": F.lag("price_close", 1).over(f.ordered)}
        )

    rows = over_series(bars.select(*s.keys, s.time, "price_close", "volume_base"), s, build, before=1)
    steps = (F.unix_seconds(s.time) - F.unix_seconds("_prev_time")) / F.lit(s.step)
    change = F.abs(F.try_divide(F.col("price_close"), F.col("_prev_close")) - 1) * 100
    report = rows.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum((steps != 1).cast("long")), F.lit(0)).alias("n_gaps"),
        F.coalesce(F.sum(F.when(steps > 1, F.floor(steps) - 1).otherwise(0)), F.lit(0)).alias("missing_rows"),
        F.sum((F.col("price_close") <= min_price).cast("long")).alias("n_low_price"),
        F.coalesce(F.sum((change > max_change_pct).cast("long")), F.lit(0)).alias("n_big_change"),
        F.sum((F.col("volume_base") < min_volume).cast("long")).alias("n_low_volume"),
    )
    pct = 100.0 * F.col("missing_rows") / (F.col("missing_rows") + F.col("n_rows"))
    return report.withColumns({"pct_missing": pct, "gaps_ok": (F.col("n_gaps") <= max_gaps).cast("int")})


def recent_rows(df: DataFrame, n: int, time: str = "timestamp", key: str = "symbol") -> DataFrame:
    """Newest n rows (top-k, no full sort)."""
    return df.orderBy(F.desc(time), key).limit(n)


def sample_rows(df: DataFrame, columns: Sequence[str], n: int, time: str = "timestamp", key: str = "symbol") -> DataFrame:
    """First n rows of a projection, for display."""
    return df.select(*columns).orderBy(time, key).limit(n)
