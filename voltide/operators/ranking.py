"""Comparison of labelings by their metrics (a table of one row per method)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIGHER_IS_BETTER = ("silhouette_score", "calinski_harabasz_score", "regime_balance", "volatility_separation",
                    "avg_regime_duration")
LOWER_IS_BETTER = ("davies_bouldin_score", "transition_frequency", "within_regime_volatility")


def _average_rank(metric: str, by: Sequence[str], descending: bool) -> Column:
    c = F.col(metric)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, metric))
    order = Window.partitionBy(*by).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return F.rank().over(order) + (ties - 1) / 2


def rank_by_metric(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average-tie ranks of three metrics and their mean."""
    out = comparison.withColumns(
        {
            "silhouette_rank": _average_rank("silhouette_score", by, True),
            "separation_rank": _average_rank("volatility_separation", by, True),
            "davies_bouldin_rank": _average_rank("davies_bouldin_score", by, False),
        }
    )
    mean = (F.col("silhouette_rank") + F.col("separation_rank") + F.col("davies_bouldin_rank")) / 3
    return out.withColumn("avg_rank", mean)


def composite_rank(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of min-max normalised metrics; a constant metric scores 0.5, a missing one is left out."""
    every = Window.partitionBy(*by)
    scores = {}
    for m in (*HIGHER_IS_BETTER, *LOWER_IS_BETTER):
        if m not in comparison.columns:
            continue
        lo, hi, v = F.min(m).over(every), F.max(m).over(every), F.col(m)
        scaled = (v - lo) / (hi - lo)
        if m in LOWER_IS_BETTER:
            scaled = 1 - scaled
        scores[f"{m}_norm"] = F.when(hi > lo, scaled).when(hi == lo, 0.5)
    out = comparison.withColumns(scores)
    present = F.filter(F.array(*scores), lambda x: x.isNotNull())
    out = out.withColumn(
        "composite_score", F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, b: a + b), F.size(present))
    )
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("composite_score"), "method")
    return out.withColumn("rank", F.row_number().over(order))


def best_method(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Method with the greatest silhouette; ties go to the alphabetically first name."""
    ranked = comparison.where(F.col("silhouette_score").isNotNull())
    best = F.min_by("method", F.struct(-F.col("silhouette_score"), F.col("method")))
    return ranked.groupBy(*by).agg(best.alias("best_method"), F.max("silhouette_score").alias("silhouette_score"))


def metric_radar(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics scaled to 0..1 for a radar chart; three are inverted."""
    every = Window.partitionBy(*by)
    axes = {}
    for m in (*HIGHER_IS_BETTER, *LOWER_IS_BETTER):
        lo, hi = F.min(m).over(every), F.max(m).over(every)
        scaled = (F.col(m) - lo) / (hi - lo + 1e-10)
        axes[f"{m}_axis"] = 1 - scaled if m in LOWER_IS_BETTER else scaled
    return comparison.select(*by, "method", *[c.alias(n) for n, c in axes.items()])
