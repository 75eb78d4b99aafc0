"""Regime labels from quantile and band rules, and the helpers all detectors share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.features import rolling_band
from voltide.operators.quantiles import approx_quantiles, exact_quantiles, spread_quantiles
from voltide.plans.series import Series

REGIME_NAMES = ("low_vol", "medium_vol", "high_vol")


def regime_name(regime: Column) -> Column:
    named = F.when(regime == 0, REGIME_NAMES[0])
    for i, name in enumerate(REGIME_NAMES[1:], 1):
        named = named.when(regime == i, name)
    return named


def vol_quantiles(df: DataFrame, by: Sequence[str] = ("symbol",), value: str = "vol_60m") -> DataFrame:
    return approx_quantiles(df, by, value, {"q33": 0.33, "q67": 0.67})


def vol_quantiles_exact(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",)) -> DataFrame:
    names = {f"{c}_q{int(p * 100)}": (c, p) for c in columns for p in (0.33, 0.67)}
    return spread_quantiles(exact_quantiles(df, by, columns, (0.33, 0.67)), by, names)


def regime_of(v: Column) -> Column:
    """0 up to q33, 1 up to q67, else (also for a NULL volatility) 2."""
    return F.when(v <= F.col("q33"), 0).when(v <= F.col("q67"), 1).otherwise(2)


def label_by_thresholds(df: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("symbol",), value: str = "vol_60m") -> DataFrame:
    """0 up to q33, 1 up to q67, else (also for a NULL volatility) 2. Works on batch and streaming ``df``."""
    out = df.join(thresholds, list(by)).withColumn("regime", regime_of(F.col(value)))
    return out.withColumn("regime_name", regime_name(F.col("regime"))).drop("q33", "q67")


def regime_threshold(df: DataFrame, by: Sequence[str] = ("symbol",), value: str = "vol_60m") -> DataFrame:
    return label_by_thresholds(df, vol_quantiles(df, by, value), by, value)


def regime_multi_indicator(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Score of volatility, volume spike and trend; without those columns the plain threshold rule."""
    if not {"volume_spike", "cum_return_60m"} <= set(df.columns):
        return regime_threshold(df, by)
    cuts = vol_quantiles_exact(df, ["vol_60m", "volume_spike"], by)
    vol, spike = F.col("vol_60m"), F.col("volume_spike")
    score = (
        F.when(vol <= F.col("vol_60m_q33"), 0.0).when(vol <= F.col("vol_60m_q67"), 1.0).otherwise(2.0)
        + F.when(spike <= F.col("volume_spike_q33"), 0.0).when(spike <= F.col("volume_spike_q67"), 0.5).otherwise(1.0)
        + F.when(F.abs("cum_return_60m") > 0.02, 0.5).otherwise(0.0)
    )
    out = df.join(cuts, list(by)).withColumn("score", score).drop(*[c for c in cuts.columns if c not in by])
    out = out.withColumn("regime", F.when(F.col("score") < 1.0, 0).when(F.col("score") < 2.5, 1).otherwise(2))
    return out.withColumn("regime_name", regime_name(F.col("regime")))


def regime_breakout(df: DataFrame, s: Series, lookback: int = 240, value: str = "vol_60m") -> DataFrame:
    v = F.col(value)
    out = rolling_band(df, s, value, lookback)
    out = out.withColumn("regime", F.when(v < F.col("vol_lower"), 0).when(v > F.col("vol_upper"), 2).otherwise(1))
    return out.withColumn("regime_name", regime_name(F.col("regime"))).drop("vol_ma", "vol_std", "vol_lower", "vol_upper")


def label_rank_map(df: DataFrame, raw: str, value: str, by: Sequence[str] = ("symbol",), clusters: int | None = None) -> DataFrame:
    """``(by, raw, regime)``: raw cluster ids ranked by ascending mean volatility.

    With ``clusters`` given, a cluster without rows counts as mean 0 (lowest rank), as three of the
    detectors want; otherwise it is left out.
    """
    means = df.groupBy(*by, raw).agg(F.avg(value).alias("mean_vol"))
    if clusters:
        every = means.select(*by).distinct().withColumn(raw, F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
        means = every.join(means, [*by, raw], "left").withColumn("mean_vol", F.coalesce("mean_vol", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("mean_vol", raw)) - 1
    return means.select(*by, raw, rank.alias("regime"), "mean_vol")


def apply_label_rank(df: DataFrame, raw: str, value: str, by: Sequence[str] = ("symbol",), clusters: int | None = None) -> DataFrame:
    ranks = label_rank_map(df, raw, value, by, clusters).drop("mean_vol")
    out = df.join(ranks, [*by, raw]).drop(raw)
    return out.withColumn("regime_name", regime_name(F.col("regime")))


def attach_labels(features: DataFrame, labels: DataFrame, on: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Inner equi-join of label columns onto the feature rows."""
    fresh = [c for c in labels.columns if c in on or c not in features.columns]
    return features.join(labels.select(*fresh), list(on), "inner")


def stack_methods(labels: dict[str, DataFrame | None]) -> DataFrame:
    """Label tables of several detectors in one long table; a detector that gave none is skipped."""
    tables = [df.withColumn("method", F.lit(name)) for name, df in labels.items() if df is not None]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def regime_distribution(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    counts = df.groupBy(*by, "regime").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def sequence_settings(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sequence length by number of bars; patches of 24 bars (fixed values)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bars"))
    n = F.col("n_bars")
    out = counts.withColumn("seq_len", F.when(n < 6000, 168).when(n < 13000, 336).otherwise(504))
    return out.withColumn("patch_len", F.lit(24)).withColumn("n_patches", F.floor(F.col("seq_len") / 24))
