"""Descriptions of regimes: feature summaries, the 23 statistics, key findings and chart tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.quantiles import exact_quantiles, spread_quantiles
from voltide.operators.spells import regime_spells
from voltide.plans.series import Series, over_series, with_row_index

SUMMARY_FEATURES = ("log_return", "vol_60m", "cum_return_60m", "volume_spike", "atr_pct")
DISPLAY_NAMES = ("Low Vol", "Medium Vol", "High Vol")
AUTOCORRELATION_LAGS = (1, 2, 24)
# statistics shown in the heat map (fixed values)
HEATMAP_STATS = ("return_mean", "return_std", "return_skew", "return_kurtosis", "vol_mean", "vol_of_vol", "rsi_mean",
                 "atr_mean", "bb_width_mean", "vol_spike_mean", "autocorr_lag1", "autocorr_lag24", "sharpe_hourly")


def regime_feature_summary(df: DataFrame, by: Sequence[str] = ("symbol", "regime"),
                           features: Sequence[str] = SUMMARY_FEATURES) -> DataFrame:
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*aggs)


def return_autocorrelation(df: DataFrame, s: Series, lags: Sequence[int] = AUTOCORRELATION_LAGS,
                           value: str = "log_return") -> DataFrame:
    """Correlation of each regime's own series, gaps closed, with its lag. Needs more than lag + 1 rows."""
    within = s.by("regime")

    def build(d, f):
        return d.withColumns({f"_lag{k}": F.lag(value, k).over(f.ordered) for k in lags})

    rows = over_series(df.select(*s.keys, "regime", s.time, value).where(F.col(value).isNotNull()), within, build,
                       before=max(lags))
    enough = F.count(F.lit(1))
    return rows.groupBy(*within.keys).agg(
        *[F.when(enough > k + 1, F.nanvl(F.corr(value, f"_lag{k}"), F.lit(None))).alias(f"autocorr_lag{k}") for k in lags]
    )


def display_name(regime: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DISPLAY_NAMES]), regime.cast("int") + 1)


def regime_stats(df: DataFrame, s: Series) -> DataFrame:
    """The 23 statistics per regime; a statistic that its rows don't define is NULL, see ``n_bars``."""
    by = [*s.keys, "regime"]
    r, v = "log_return", "vol_60m"
    positive = F.avg(F.when(F.col(r) > 0, 1.0).when(F.col(r).isNotNull(), 0.0)) * 100
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.avg(r).alias("return_mean"), F.stddev_samp(r).alias("return_std"),
        F.skewness(r).alias("return_skew"), F.kurtosis(r).alias("return_kurtosis"),
        positive.alias("pct_positive"),
        F.avg(v).alias("vol_mean"), F.stddev_samp(v).alias("vol_std"),
        F.avg("rsi").alias("rsi_mean"), F.stddev_samp("rsi").alias("rsi_std"),
        F.avg("atr_pct").alias("atr_mean"), F.avg("bb_width").alias("bb_width_mean"),
        F.avg("volume_spike").alias("vol_spike_mean"),
    )
    share = 100.0 * F.col("n_bars") / F.sum("n_bars").over(Window.partitionBy(*s.keys))
    stats = stats.withColumn("pct_of_total", share)
    cuts = {"vol_p25": (v, 0.25), "vol_median": (v, 0.5), "vol_p75": (v, 0.75), "vol_p95": (v, 0.95)}
    quantiles = spread_quantiles(exact_quantiles(df, by, [v], [p for _, p in cuts.values()]), by, cuts)
    out = stats.join(quantiles, by, "left").join(return_autocorrelation(df, s), by, "left")
    return out.withColumns(
        {
            "regime_name": display_name(F.col("regime")),
            "sharpe_hourly": F.when(F.col("return_std") > 0, F.col("return_mean") / F.col("return_std")).otherwise(0.0),
            "vol_of_vol": F.when(F.col("vol_mean") > 0, F.col("vol_std") / F.col("vol_mean")),
        }
    )


def key_findings(stats: DataFrame, matrix: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Most volatile, most common and most persistent regime."""
    volatile = stats.groupBy(*by).agg(
        F.max_by("regime", F.struct("vol_mean", -F.col("regime"))).alias("most_volatile"),
        F.max_by("regime", F.struct("pct_of_total", -F.col("regime"))).alias("most_common"),
    )
    stay = matrix.where(F.col("from_regime") == F.col("to_regime"))
    lasting = stay.groupBy(*by).agg(
        F.max_by("from_regime", F.struct("probability", -F.col("from_regime"))).alias("most_persistent"),
        F.max("probability").alias("p_stay"),
    )
    return volatile.join(lasting, list(by))


# chart tables ----------------------------------------------------------------------------------
def stride_downsample(df: DataFrame, s: Series, n: int = 10000) -> DataFrame:
    """Every k-th row of each series, k = rows div n."""
    indexed = with_row_index(df, s)
    step = F.when(F.col("n_rows") > n, F.floor(F.col("n_rows") / F.lit(n))).otherwise(1)
    return indexed.where(F.col("rn") % step == 0).drop("rn", "n_rows")


def regime_timeline(df: DataFrame, s: Series) -> DataFrame:
    """Contiguous regime spans of all rows; a chart thins only the price line (:func:`stride_downsample`)."""
    return regime_spells(df.select(*s.keys, s.time, "regime"), s)


def feature_box_stats(df: DataFrame, features: Sequence[str], by: Sequence[str] = ("symbol", "regime")) -> DataFrame:
    """Quartiles and the furthest values within 1.5 interquartile ranges, long form."""
    by = list(by)
    quartiles = exact_quantiles(df, by, features, (0.25, 0.5, 0.75))
    q = quartiles.groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    )
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features]))
    long = df.select(*by, stacked.alias("_s")).select(*by, "_s.feature", "_s.v").where(F.col("v").isNotNull())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low = F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))
    high = F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))
    return (
        long.join(q, [*by, "feature"])
        .groupBy(*by, "feature", "q1", "median", "q3")
        .agg(F.min(low).alias("whisker_low"), F.max(high).alias("whisker_high"))
    )


def regime_heatmap(stats: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each statistic standardised across the regimes of a symbol, long form."""
    long = stats.select(*by, "regime", *[F.col(c).cast("double").alias(c) for c in HEATMAP_STATS]).unpivot(
        [*by, "regime"], list(HEATMAP_STATS), "stat", "value"
    )
    across = Window.partitionBy(*by, "stat")
    z = (F.col("value") - F.avg("value").over(across)) / (F.stddev_samp("value").over(across) + 1e-10)
    return long.withColumn("z", z).drop("value")


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: Column) -> DataFrame:
    """Equal-width bins between the extremes of each group, the last bin closed on the right."""
    by = list(by)
    limits = df.groupBy(*by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("n_values"), F.avg(value).alias("mean")
    ).withColumn("bins", bins)
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    limits = limits.withColumns({"_low": lo.cast("double"), "_width": ((hi - lo) / F.col("bins")).cast("double")})
    index = F.least(F.floor((F.col(value) - F.col("_low")) / F.col("_width")), F.col("bins") - 1)
    counted = df.where(F.col(value).isNotNull()).join(limits, by).withColumn("bin", index)
    return counted.groupBy(*by, "bin", "bins", "mean", "_low", "_width").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", "bins", "n", "mean",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"), F.col("_width").alias("bin_width"),
    )


def duration_histogram(spells: DataFrame, by: Sequence[str] = ("symbol", "regime")) -> DataFrame:
    return histogram(spells, by, "duration", F.least(F.lit(50), F.floor(F.col("n_values") / 2) + 1))


def forecast_vol_histogram(forecasts: DataFrame, by: Sequence[str] = ("symbol", "regime"), bins: int = 50) -> DataFrame:
    return histogram(forecasts, by, "rs_vol", F.lit(bins))


#: Bandwidths at which a Gaussian kernel is cut off: what is left out is below exp(-32) = 1.3e-14 of its height.
KERNEL_REACH = 8


def return_density(df: DataFrame, by: Sequence[str] = ("symbol", "regime"), value: str = "log_return", points: int = 1000) -> DataFrame:
    """Gaussian kernel density per group on a grid half a range wider than the data (Scott bandwidth).

    Each row adds its kernel to the grid points within ``KERNEL_REACH`` bandwidths, inside its task; only grid sums are shuffled. The
    bandwidth falls with the fifth root of the rows, and so do a row's points; the error is at most 1.3e-14 / (h sqrt(2 pi)), far below
    rounding. Equal values are one row of that weight. A group without variation keeps its grid, with a NULL density; a null key is a
    group like others.
    """
    # As one struct, keys that are null are equal in the joins.
    values = df.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_group"), F.col(value).cast("double").alias("_x"))
    rows = values.groupBy("_group", "_x").agg(F.count(F.lit(1)).alias("_w"))
    shape = values.groupBy("_group").agg(
        F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_s"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    span = F.col("_hi") - F.col("_lo")
    step = 2 * span / (points - 1)
    start = F.col("_lo") - span / 2
    shape = shape.withColumns({"_h": F.when(F.col("_s") > 0, F.col("_s") * F.pow(F.col("_n"), F.lit(-0.2))), "_start": start, "_step": step})
    shape = shape.select("_group", "_n", "_h", "_start", "_step")
    x = F.col("_start") + F.col("point") * F.col("_step")
    low = F.greatest(F.lit(0), F.ceil((F.col("_x") - KERNEL_REACH * F.col("_h") - F.col("_start")) / F.col("_step")).cast("int"))
    high = F.least(F.lit(points - 1), F.floor((F.col("_x") + KERNEL_REACH * F.col("_h") - F.col("_start")) / F.col("_step")).cast("int"))
    near = rows.join(shape.where("_h > 0"), "_group").withColumns({"_from": low, "_to": high}).where("_from <= _to")
    near = near.withColumn("point", F.explode(F.sequence("_from", "_to")))
    kernel = F.col("_w") * F.exp(-0.5 * F.pow((x - F.col("_x")) / F.col("_h"), 2))
    sums = near.groupBy("_group", "point").agg(F.sum(kernel).alias("_k"))
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    density = F.when(F.col("_h").isNotNull(), F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)))
    return grid.join(sums, ["_group", "point"], "left").select("_group.*", "point", x.alias("x"), density.alias("density"))
