"""Regimes from fitted models: k-means, Gaussian mixture, GARCH features and sequence embeddings.

Features are standardised per symbol and one model is fitted over the symbols given, so its size does not
grow with their number; pass a single symbol for a model of its own. Cluster ids are ranked by mean volatility
per symbol. Rows never leave the executors: only centers, costs and likelihoods reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.operators.cleaning import standardise
from voltide.operators.garch import garch_variance
from voltide.operators.garch_fit import garch_fit
from voltide.operators.kmeans import Clusters, Spread, fit_many, moved, nearest_sums, points
from voltide.operators.regime_rules import apply_label_rank, vol_quantiles_exact
from voltide.plans.series import Series, over_series
from voltide.session import materialise

# features of the detectors (fixed values)
FEATURES = ("log_return", "vol_60m", "vol_240m", "vol_ratio_60_240", "cum_return_60m", "return_skew_60m", "volume_spike",
            "rsi", "bb_width", "atr_pct")
GARCH_FEATURES = ("global_garch_vol", "standardised_return", "garch_vol_ratio", "arch_indicator")
GARCH_WEIGHT = 3.0
K, SEED = 3, 42
PARALLEL_FITS = 4


def feature_names(columns: Sequence[str], wanted: Sequence[str] = FEATURES) -> list[str]:
    names = [c for c in wanted if c in columns]
    if len(names) < 3:
        raise ValueError(f"need at least 3 of {list(wanted)}, have {names}")
    return names


def scaled_vectors(df: DataFrame, features: Sequence[str], s: Series, keep: Sequence[str] = ()) -> DataFrame:
    """``(keys, time, keep, features)`` with the standardised features as one vector, written once for the fits."""
    rows = standardise(df, features, s.keys)
    vectors = VectorAssembler(inputCols=[f"z_{c}" for c in features], outputCol="features").transform(rows)
    return materialise(vectors.select(*s.keys, s.time, *keep, "features"), "vectors")


def _best(fits: Sequence[Callable[[], object]], score: Callable[[object], float]):
    """Independent fits submitted together; the best score wins, earlier seeds win ties."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = list(pool.map(lambda fit: fit(), fits))
    return max(models, key=score)


def fit_kmeans(vectors: DataFrame, k: int = K, n_init: int = 10, max_iter: int = 300, seed: int = SEED) -> Clusters:
    return fit_many(vectors, [k], n_init, max_iter, seed)[0]


def _ranked(df: DataFrame, clusters: DataFrame, s: Series, value: str, k: int | None, extra: Sequence[str] = ()) -> DataFrame:
    """Feature rows with the ranked regime of their cluster."""
    joined = df.join(clusters.select(*s.keys, s.time, "cluster", *extra), [*s.keys, s.time])
    return apply_label_rank(joined, "cluster", value, s.keys, k)


def regime_kmeans(df: DataFrame, s: Series, k: int = K, n_init: int = 10, max_iter: int = 300) -> DataFrame:
    vectors = scaled_vectors(df, feature_names(df.columns), s)
    model = fit_kmeans(vectors, k, n_init, max_iter)
    return _ranked(df, model.transform(vectors), s, "vol_60m", k)


def kmeans_centers(df: DataFrame, s: Series, k: int = K, n_init: int = 10) -> DataFrame:
    """Center coordinates in standardised units, long form, with the inertia."""
    names = feature_names(df.columns)
    model = fit_kmeans(scaled_vectors(df, names, s), k, n_init)
    rows = [(i, n, float(v), model.inertia) for i, c in enumerate(model.centers) for n, v in zip(names, c)]
    return df.sparkSession.createDataFrame(rows, "cluster int, feature string, center double, inertia double")


def kmeans_elbow(df: DataFrame, s: Series, max_k: int = 10, n_init: int = 10) -> DataFrame:
    vectors = scaled_vectors(df, feature_names(df.columns), s)
    ks = range(2, max_k + 1)
    rows = [(k, model.inertia) for k, model in zip(ks, fit_many(vectors, ks, n_init))]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def kmeans_step(df: DataFrame, s: Series, features: Sequence[str], centers: np.ndarray) -> DataFrame:
    """What one pass makes of given centers: ``cluster, n, inertia`` and the mean of each standardised feature."""
    sums = nearest_sums(Spread(points(scaled_vectors(df, features, s), "features")), [centers])[0]
    after = moved(centers, sums)
    rows = [(i, int(x[-2]), float(x[-1]), *map(float, c)) for i, (x, c) in enumerate(zip(sums, after))]
    return df.sparkSession.createDataFrame(rows, "cluster int, n long, inertia double, " + ", ".join(f"{f} double" for f in features))


# mixture ---------------------------------------------------------------------------------------
def fit_gmm(vectors: DataFrame, k: int = K, n_init: int = 10, max_iter: int = 100, seed: int = SEED) -> GaussianMixtureModel:
    def fit(i: int):
        return lambda: GaussianMixture(k=k, maxIter=max_iter, tol=1e-3, seed=seed + i, featuresCol="features").fit(vectors)

    return _best([fit(i) for i in range(n_init)], lambda m: m.summary.logLikelihood)


def regime_gmm(df: DataFrame, s: Series, k: int = K, n_init: int = 10, max_iter: int = 100) -> DataFrame:
    """Mixture label, its probability, and 1 - (best - second best) as uncertainty."""
    vectors = scaled_vectors(df, feature_names(df.columns), s)
    model = fit_gmm(vectors, k, n_init, max_iter).setPredictionCol("cluster")
    ordered = F.sort_array(vector_to_array("probability"), asc=False)
    scored = model.transform(vectors).withColumn("_p", ordered).withColumns(
        {"regime_probability": F.col("_p")[0], "regime_uncertainty": 1 - (F.col("_p")[0] - F.col("_p")[1])}
    )
    return _ranked(df, scored, s, "vol_60m", k, ("regime_probability", "regime_uncertainty"))


def gmm_diagnostics(df: DataFrame, s: Series, k: int = K, n_init: int = 10, max_iter: int = 100) -> DataFrame:
    """Weights and means of the components, with BIC and AIC of the model."""
    names = feature_names(df.columns)
    vectors = scaled_vectors(df, names, s)
    model = fit_gmm(vectors, k, n_init, max_iter)
    d, loglik = len(names), float(model.summary.logLikelihood)
    free = float(k - 1 + k * d + k * d * (d + 1) // 2)
    means = model.gaussiansDF.select("mean").collect()
    rows = [
        (i, float(w), n, float(m)) for i, (w, g) in enumerate(zip(model.weights, means)) for n, m in zip(names, g["mean"])
    ]
    out = df.sparkSession.createDataFrame(rows, "component int, weight double, feature string, mean double")
    n = vectors.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return out.crossJoin(F.broadcast(n)).withColumns(
        {"bic": free * F.ln("_n") - 2 * loglik, "aic": F.lit(2 * free - 2 * loglik)}
    ).drop("_n")


# GARCH -----------------------------------------------------------------------------------------
def garch_features(df: DataFrame, params: DataFrame, s: Series) -> DataFrame:
    """Conditional volatility, standardised return, short / long volatility ratio and squared shock."""
    rows = garch_variance(df, params, s, out="_gv").withColumn("global_garch_vol", F.sqrt("_gv"))
    vol = F.col("global_garch_vol")

    def build(d, f):
        short, long = F.avg("global_garch_vol").over(f.rows(24)), F.avg("global_garch_vol").over(f.rows(168))
        return d.withColumn("garch_vol_ratio", F.when(long > 1e-10, short / long).otherwise(1.0))

    rows = over_series(rows, s, build, before=167)
    shock = F.when(vol > 1e-10, F.col("log_return") / vol).otherwise(0.0)
    return rows.withColumns({"standardised_return": shock, "arch_indicator": shock * shock}).drop("_gv")


def regime_garch(df: DataFrame, s: Series, k: int = K, n_init: int = 30, max_iter: int = 500) -> tuple[DataFrame, DataFrame]:
    """Labels with ``garch_variance, garch_volatility, global_garch_vol``, and the parameters per regime."""
    rows = materialise(garch_features(df, garch_fit(df, s), s), "garch_features")
    names = feature_names(df.columns)
    every = [*names, *GARCH_FEATURES]
    scaled = standardise(rows, every, s.keys).withColumns({f"z_{c}": F.col(f"z_{c}") * GARCH_WEIGHT for c in GARCH_FEATURES})
    vectors = VectorAssembler(inputCols=[f"z_{c}" for c in every], outputCol="features").transform(scaled)
    vectors = materialise(vectors.select(*s.keys, s.time, "features"), "vectors")
    clusters = fit_kmeans(vectors, k, n_init, max_iter).transform(vectors)
    labels = materialise(_ranked(rows, clusters, s, "global_garch_vol", None), "garch_labels")
    within = s.by("regime")
    params = materialise(garch_fit(labels, within), "garch_params")
    out = garch_variance(labels, params, within, out="garch_variance").withColumn("garch_volatility", F.sqrt("garch_variance"))
    return out.drop("standardised_return", "garch_vol_ratio", "arch_indicator"), params


# sequences -------------------------------------------------------------------------------------
def sequence_windows(df: DataFrame, s: Series, features: Sequence[str], seq_len: int = 168, patch_len: int = 24) -> DataFrame:
    """For each row the means of the ``seq_len / patch_len`` patches before it (patch 0 is the newest).

    One rolling mean per feature, then lags of it: nothing as long as the sequence is ever built. Rows without
    a full sequence have ``has_sequence`` false.
    """
    patches = seq_len // patch_len

    def build(d, f):
        d = d.withColumns({f"_m_{c}": F.avg(c).over(f.rows(patch_len)) for c in features})
        cols = {
            f"{c}_p{j}": F.lag(f"_m_{c}", j * patch_len + 1).over(f.ordered) for c in features for j in range(patches)
        }
        cols["has_sequence"] = F.count(F.lit(1)).over(f.between(-seq_len, -1)) == seq_len
        return d.withColumns(cols).drop(*[f"_m_{c}" for c in features])

    return over_series(df, s, build, before=seq_len + patch_len - 1)


def patch_columns(features: Sequence[str], seq_len: int, patch_len: int) -> list[str]:
    return [f"{c}_p{j}" for c in features for j in range(seq_len // patch_len)]


def head_fill(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Rows without a value take the first one of their series."""
    first = df.where(F.col(value).isNotNull()).groupBy(*s.keys).agg(F.min_by(value, s.time).alias("_first"))
    return df.join(first, list(s.keys), "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")


def _sequence_vectors(df: DataFrame, s: Series, seq_len: int, patch_len: int, keep: Sequence[str] = ()) -> DataFrame:
    names = feature_names(df.columns)
    scaled = standardise(df, names, s.keys).select(*s.keys, s.time, *keep, *[f"z_{c}" for c in names])
    z = [f"z_{c}" for c in names]
    rows = sequence_windows(scaled, s, z, seq_len, patch_len).where(F.col("has_sequence"))
    vectors = VectorAssembler(inputCols=patch_columns(z, seq_len, patch_len), outputCol="sequence").transform(rows)
    return materialise(vectors.select(*s.keys, s.time, *keep, "sequence"), "sequences")


def _cluster_embedding(df: DataFrame, embedded: DataFrame, s: Series, k: int, n_init: int) -> DataFrame:
    vectors = materialise(embedded.select(*s.keys, s.time, "features"), "embedding")
    clusters = fit_kmeans(vectors, k, n_init).transform(vectors).select(*s.keys, s.time, "cluster")
    filled = head_fill(df.join(clusters, [*s.keys, s.time], "left"), s, "cluster").where(F.col("cluster").isNotNull())
    return apply_label_rank(filled, "cluster", "vol_60m", s.keys)


def principal_axes(rows: DataFrame, column: str, components: int) -> np.ndarray:
    """Leading axes of the covariance. Spark sums the moments; only the matrix of the columns is decomposed here."""
    moments = rows.select(Summarizer.metrics("std").summary(F.col(column)).alias("m")).select("m.std").first()[0].toArray()
    correlation = Correlation.corr(rows, column).first()[0].toArray()
    covariance = np.nan_to_num(correlation) * np.outer(moments, moments)
    _values, vectors = np.linalg.eigh(covariance)
    return vectors[:, ::-1][:, :components].copy()


def regime_patch_embedding(df: DataFrame, s: Series, seq_len: int = 168, patch_len: int = 24, components: int = 8,
                           k: int = K, n_init: int = 20) -> DataFrame:
    """Patch sequences, compressed without labels (principal components), then clustered."""
    sequences = _sequence_vectors(df, s, seq_len, patch_len)
    axes = principal_axes(sequences, "sequence", components)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ axes))

    embedded = sequences.withColumn("features", array_to_vector(project(vector_to_array("sequence"))))
    return _cluster_embedding(df, embedded, s, k, n_init)


def regime_pseudo_label_embedding(df: DataFrame, s: Series, seq_len: int = 168, patch_len: int = 24, hidden: int = 16,
                                  k: int = K, n_init: int = 20, max_iter: int = 60) -> DataFrame:
    """A network learns volatility-quantile labels from sequences; its last layer is clustered."""
    cuts = vol_quantiles_exact(df, ["vol_60m"], s.keys)
    v = F.col("vol_60m")
    target = F.when(v <= F.col("vol_60m_q33"), 0.0).when(v <= F.col("vol_60m_q67"), 1.0).otherwise(2.0)
    rows = df.join(cuts, list(s.keys)).withColumn("target", target)
    sequences = _sequence_vectors(rows, s, seq_len, patch_len, keep=("target",))
    inputs = len(feature_names(df.columns)) * (seq_len // patch_len)
    network = MultilayerPerceptronClassifier(
        layers=[inputs, hidden, 3], maxIter=max_iter, seed=SEED, featuresCol="sequence", labelCol="target",
        rawPredictionCol="features",
    ).fit(sequences)
    return _cluster_embedding(df, network.transform(sequences), s, k, n_init)
