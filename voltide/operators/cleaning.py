"""Projections, filters and cleaning of candles and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "timestamp", "price_open", "price_high", "price_low", "price_close", "volume_base",
               "volume_quote", "num_trades")

# the columns the detectors know, in order (fixed values)
REGIME_FEATURES = ("timestamp", "price_close", "log_return", "vol_60m", "vol_240m", "vol_ratio_60_240",
                   "cum_return_60m", "return_skew_60m", "volume_spike", "rsi", "bb_width", "atr_pct")


def epoch_to_timestamp(epoch: Column) -> Column:
    """Seconds, milliseconds or microseconds since 1970, told apart by size."""
    return (
        F.when(epoch > 1_000_000_000_000_000, F.timestamp_micros(epoch))
        .when(epoch > 1_000_000_000_000, F.timestamp_millis(epoch))
        .otherwise(F.timestamp_seconds(epoch))
    )


def valid_candles(df: DataFrame, strict: bool = True) -> DataFrame:
    """Keep candles with positive prices and high >= low; ``strict`` also wants close inside the range."""
    keep = (F.col("open") > 0) & (F.col("close") > 0) & (F.col("high") >= F.col("low"))
    if strict:
        keep = keep & (F.col("high") >= F.col("close")) & (F.col("low") <= F.col("close"))
    return df.where(keep)


def dedup_bars(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one with the greatest ``newest`` columns, whatever the input order.

    An aggregate and not a window: duplicates of one key are merged before the shuffle.
    """
    order = F.struct(*[F.col(c) for c in newest])
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def calendar_columns(df: DataFrame, time: str = "timestamp") -> DataFrame:
    t = F.col(time)
    return df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)})


def canonical_bars(candles: DataFrame) -> DataFrame:
    """Candle columns renamed to the bar schema; the return stays NULL until the series is in order."""
    bars = candles.select(
        "symbol",
        epoch_to_timestamp(F.col("open_time")).alias("timestamp"),
        F.col("open").alias("price_open"),
        F.col("high").alias("price_high"),
        F.col("low").alias("price_low"),
        F.col("close").alias("price_close"),
        F.col("volume").alias("volume_base"),
        F.col("quote_volume").alias("volume_quote"),
        F.col("trades").alias("num_trades"),
        F.lit(None).cast("double").alias("log_return"),
    )
    return calendar_columns(bars)


def resolve_columns(available: Sequence[str], *wanted: Sequence[str]) -> list[str | None]:
    """For each ordered list of names the first one that exists."""
    return [next((c for c in names if c in available), None) for names in wanted]


def regime_feature_select(df: DataFrame, key: str = "symbol") -> tuple[DataFrame, list[str]]:
    """Known feature columns that exist, without incomplete rows; and the names that are missing."""
    present = [c for c in REGIME_FEATURES if c in df.columns]
    missing = [c for c in REGIME_FEATURES if c not in df.columns]
    return df.select(key, *present).dropna(), missing


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    v = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(v) == float("inf"), 0.0).otherwise(v)


def fill_defaults(df: DataFrame, returns: str = "log_return", regime: str = "regime") -> DataFrame:
    out = df.withColumn(returns, finite_or_zero(F.col(returns)))
    return out.withColumn(regime, F.coalesce(F.col(regime), F.lit(0))) if regime in df.columns else out


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",), prefix: str = "z_") -> DataFrame:
    """(x - mean) / population deviation per group, missing values as 0, a zero deviation as 1.

    The moments (one row per group) are joined back; Spark picks the join from their size.
    """
    filled = df.withColumns({c: finite_or_zero(F.col(c)) for c in columns})
    moments = filled.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    joined = filled.join(moments, list(by)) if by else filled.crossJoin(F.broadcast(moments))

    def scaled(c: str) -> Column:
        sigma = F.col(f"_s_{c}")
        return (F.col(c) - F.col(f"_m_{c}")) / F.when(sigma > 0, sigma).otherwise(1.0)

    out = joined.withColumns({prefix + c: scaled(c) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])
