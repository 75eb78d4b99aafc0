"""Quality metrics of regime labelings, grouped by ``by`` (symbol, or symbol and method)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators.cleaning import resolve_columns, standardise
from voltide.operators.spells import regime_change_flag
from voltide.plans.series import Series

# preferred column names, first that exists wins (fixed values)
VOL_NAMES = ("vol_60m", "vol_24h", "vol_30m", "realized_vol_1h")
LONG_VOL_NAMES = ("vol_240m", "vol_168h", "vol_720h")
CUM_RETURN_NAMES = ("cum_return_60m", "cum_return_24h", "cum_return_30m")
SILHOUETTE_CAP = 10_000
Z = "z_"


def evaluation_features(columns: Sequence[str]) -> list[str]:
    vol, long_vol, cum = resolve_columns(columns, VOL_NAMES, LONG_VOL_NAMES, CUM_RETURN_NAMES)
    names = ["log_return", vol, long_vol, cum, "volume_spike" if "volume_spike" in columns else None]
    return [c for c in names if c]


def capped_sample(df: DataFrame, by: Sequence[str], cap: int, row_key: Sequence[str]) -> DataFrame:
    """A repeatable sample of about ``cap`` rows per group (all rows of smaller groups).

    Rows are kept by a digest of their key (as text) against cap / group size, so no group is sorted or gathered.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key])
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    kept = df.join(sizes, list(by)).where((F.col("_n") <= cap) | (draw < F.lit(float(cap)) / F.col("_n")))
    return kept.drop("_n")


def _silhouette_of_group(x: np.ndarray, labels: np.ndarray, block: int = 512) -> float | None:
    groups, codes, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(groups) < 2:
        return None
    member = np.eye(len(groups))[codes]
    square = (x * x).sum(axis=1)
    total = 0.0
    for i in range(0, len(x), block):
        part, own = x[i:i + block], codes[i:i + block]
        rows = np.arange(len(part))
        apart = square[i:i + block, None] + square[None, :] - 2.0 * part @ x.T
        apart = np.sqrt(np.maximum(apart, 0.0))
        apart[rows, i + rows] = 0.0
        sums = apart @ member
        inside = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[rows, own] = np.inf
        nearest = means.min(axis=1)
        scale = np.maximum(inside, nearest)
        score = np.divide(nearest - inside, scale, out=np.zeros_like(scale), where=scale > 0)
        total += score[sizes[own] > 1].sum()
    return total / len(x)


def silhouette_euclidean(df: DataFrame, by: Sequence[str] = ("symbol",), features: Sequence[str] | None = None,
                         row_key: Sequence[str] = ("symbol", "timestamp"), cap: int = SILHOUETTE_CAP) -> DataFrame:
    """Mean Euclidean silhouette on at most about ``cap`` rows per group.

    The cap is the definition of the metric and bounds the group each task receives. Use
    :func:`silhouette_squared` for a form that uses all rows.
    """
    features = list(features or evaluation_features(df.columns))
    z = [Z + c for c in features]
    sample = capped_sample(standardise(df, features, by), by, cap, row_key)
    fields = [sample.schema[c] for c in by] + [T.StructField("silhouette_score", T.DoubleType())]

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value = _silhouette_of_group(rows[z].to_numpy(), rows["regime"].to_numpy())
        return pd.DataFrame([[*key, value]], columns=[*by, "silhouette_score"])

    return sample.select(*by, "regime", *z).groupBy(*by).applyInPandas(score, T.StructType(fields))


def silhouette_squared(df: DataFrame, by: Sequence[str] = ("symbol",), features: Sequence[str] | None = None) -> DataFrame:
    """Squared-Euclidean silhouette of every row from the moments of the clusters, no pairs formed."""
    features = list(features or evaluation_features(df.columns))
    z = [Z + c for c in features]
    rows = standardise(df, features, by).select(*by, "regime", *z).withColumn("_row", F.monotonically_increasing_id())
    norm = sum((F.col(c) * F.col(c) for c in z), F.lit(0.0))
    clusters = rows.groupBy(*by, F.col("regime").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("norms"), F.array(*[F.sum(c) for c in z]).alias("sums")
    )
    packed = clusters.groupBy(*by).agg(F.collect_list(F.struct("cluster", "n", "norms", "sums")).alias("_clusters"))
    point = F.array(*z)

    def mean_distance(c):
        dot = F.aggregate(F.zip_with(point, c["sums"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        total = c["n"] * norm + c["norms"] - 2 * dot
        own = c["cluster"] == F.col("regime")
        return F.struct(own.alias("own"), c["n"].alias("n"),
                        F.try_divide(total, F.when(own, c["n"] - 1).otherwise(c["n"])).alias("d"))

    scored = rows.join(packed, list(by)).withColumn("_d", F.transform("_clusters", mean_distance))
    inside = F.filter("_d", lambda d: d["own"])[0]
    nearest = F.array_min(F.transform(F.filter("_d", lambda d: ~d["own"]), lambda d: d["d"]))
    a, b = inside["d"], nearest
    value = F.when(inside["n"] <= 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return scored.groupBy(*by).agg(F.avg(F.when(nearest.isNotNull(), value)).alias("silhouette_squared"))


def _centroids(z_rows: DataFrame, by: Sequence[str], z: Sequence[str]) -> DataFrame:
    return z_rows.groupBy(*by, "regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in z]).alias("center"),
        F.array(*[F.var_pop(c) for c in z]).alias("spread"),
    )


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def calinski_harabasz(df: DataFrame, by: Sequence[str] = ("symbol",), features: Sequence[str] | None = None) -> DataFrame:
    """Between / within dispersion from one aggregate; features are standardised, so the grand mean is 0."""
    features = list(features or evaluation_features(df.columns))
    centers = _centroids(standardise(df, features, by), by, [Z + c for c in features])
    parts = centers.groupBy(*by).agg(
        F.sum(F.col("n") * _sum(F.transform("center", lambda m: m * m))).alias("between"),
        F.sum(F.col("n") * _sum(F.col("spread"))).alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
    )
    ratio = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return parts.select(*by, ratio.alias("calinski_harabasz_score"))


def davies_bouldin(df: DataFrame, by: Sequence[str] = ("symbol",), features: Sequence[str] | None = None) -> DataFrame:
    features = list(features or evaluation_features(df.columns))
    z = [Z + c for c in features]
    rows = standardise(df, features, by)
    centers = _centroids(rows, by, z).select(*by, "regime", "center")
    distance = F.sqrt(_sum(F.zip_with(F.array(*z), F.col("center"), lambda a, b: (a - b) * (a - b))))
    scatter = rows.join(centers, [*by, "regime"]).groupBy(*by, "regime", "center").agg(F.avg(distance).alias("scatter"))
    # k rows per group, so packing them into one array is bounded by the number of regimes
    packed = scatter.groupBy(*by).agg(F.collect_list(F.struct("regime", "center", "scatter")).alias("_c"))

    def worst(one):
        def similarity(other):
            gap = F.sqrt(_sum(F.zip_with(one["center"], other["center"], lambda a, b: (a - b) * (a - b))))
            return F.try_divide(one["scatter"] + other["scatter"], gap)

        others = F.filter("_c", lambda other: other["regime"] != one["regime"])
        return F.array_max(F.transform(others, similarity))

    worsts = F.transform("_c", worst)
    return packed.select(*by, F.try_divide(_sum(worsts), F.size("_c")).alias("davies_bouldin_score"))


def duration_and_change(df: DataFrame, s: Series) -> DataFrame:
    """Average spell length and share of rows with a label change, on all rows in time order."""
    flagged = regime_change_flag(df.select(*s.keys, s.time, "regime"), s)
    n, changes = F.count(F.lit(1)), F.sum("changed")
    return flagged.groupBy(*s.keys).agg(
        (n / (changes + 1)).alias("avg_regime_duration"), (changes / n).alias("transition_frequency")
    )


def regime_balance(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entropy of the regime shares over its maximum; 0 with a single regime."""
    counts = df.groupBy(*by, "regime").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*by).agg(F.collect_list("n").alias("_n"), F.sum("n").alias("_total"))

    def part(n):
        share = n / F.col("_total")
        return -share * F.ln(share + 1e-10)

    entropy = _sum(F.transform("_n", part))
    balance = F.when(F.size("_n") > 1, F.try_divide(entropy, F.ln(F.size("_n")))).otherwise(0.0)
    return packed.select(*by, balance.alias("regime_balance"))


def anova_f(groups: DataFrame, by: Sequence[str], n: str, mean: str, var: str) -> DataFrame:
    """One-way ANOVA F from (count, mean, sample variance) per group."""
    n_, m_ = F.col(n), F.col(mean)
    within = F.when(n_ > 1, (n_ - 1) * F.col(var)).otherwise(0.0)
    parts = groups.groupBy(*by).agg(
        F.sum(n_ * m_).alias("_t"), F.sum(n_ * m_ * m_).alias("_q"), F.sum(within).alias("_w"),
        F.sum(n_).alias("_n"), F.count(F.lit(1)).alias("_k"),
    )
    between = (F.col("_q") - F.col("_t") * F.col("_t") / F.col("_n"))
    f = F.try_divide(between * (F.col("_n") - F.col("_k")), F.col("_w") * (F.col("_k") - 1))
    return parts.select(*by, f.alias("volatility_separation"))


def volatility_separation(df: DataFrame, by: Sequence[str] = ("symbol",), value: str | None = None) -> DataFrame:
    value = value or resolve_columns(df.columns, VOL_NAMES)[0]
    groups = df.groupBy(*by, "regime").agg(
        F.count(value).alias("_gn"), F.avg(value).alias("_gm"), F.var_samp(value).alias("_gv")
    )
    return anova_f(groups.where(F.col("_gn") > 0), by, "_gn", "_gm", "_gv")


def within_regime_volatility(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    groups = df.groupBy(*by, "regime").agg(
        F.count(F.lit(1)).alias("_gn"), F.stddev_samp("log_return").alias("_gs")
    )
    weighted = F.try_divide(F.sum(F.col("_gn") * F.col("_gs")), F.sum("_gn"))
    return groups.groupBy(*by).agg(F.coalesce(weighted, F.lit(0.0)).alias("within_regime_volatility"))


def evaluate_regimes(df: DataFrame, s: Series) -> DataFrame:
    """All metrics of each labeling over all its rows, the silhouette on squared distances; one row per ``s.keys`` (use ``s.by("method")`` for stacked methods)."""
    by = list(s.keys)
    out = silhouette_squared(df, by).withColumnRenamed("silhouette_squared", "silhouette_score")
    for metric in (
        calinski_harabasz(df, by), davies_bouldin(df, by), duration_and_change(df, s), regime_balance(df, by),
        volatility_separation(df, by), within_regime_volatility(df, by),
    ):
        out = out.join(metric, by, "left")
    return out
