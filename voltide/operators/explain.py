"""What separates the regimes: forests, permutation importance and Shapley values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltide.operators.cleaning import standardise
from voltide.operators.forest import Forest, changed_predictions, saved_forest, shapley_values
from voltide.operators.regime_models import FEATURES, SEED, feature_names
from voltide.plans.series import Series, with_row_index
from voltide.session import materialise

BLOCK_ROWS = 4096
SCATTER = (1_000_003, 998_244_353, 754_974_721)
PRIMES = (4099, 4111, 4127, 4129, 4133, 4139, 4153, 4157, 4159, 4177)  # above BLOCK_ROWS, so they divide no block


def training_rows(df: DataFrame, s: Series, features: Sequence[str] = FEATURES) -> tuple[DataFrame, list[str]]:
    """``(keys, rn, n_rows, label, x)`` with standardised features as an array, written once."""
    names = feature_names(df.columns, features)
    rows = with_row_index(standardise(df, names, s.keys).select(*s.keys, s.time, "regime", *[f"z_{c}" for c in names]), s)
    x = F.array(*[f"z_{c}" for c in names])
    return materialise(rows.select(*s.keys, "rn", "n_rows", F.col("regime").cast("double").alias("label"), x.alias("x")), "training"), names


def fit_forest(rows: DataFrame, trees: int = 200, depth: int = 8, seed: int = SEED) -> RandomForestClassificationModel:
    """Random forest with balanced class weights n / (k * n_class)."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()
    weights = sizes.withColumn("weight", F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).drop("_n")
    # one row per class
    weighted = rows.join(F.broadcast(weights), "label").withColumn("features", array_to_vector("x"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed, featureSubsetStrategy="sqrt"
    )
    return forest.fit(weighted.select("label", "weight", "features"))


def accuracy(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows.withColumn("features", array_to_vector("x")))
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def _blocks(rows: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Rows with ``_at``, their place in a scattered order of their series, and ``_block`` of about ``block_rows`` such places.

    The place is the row index times a prime, modulo the length; of a fixed list the first prime that does not divide
    the length, so that no two rows share a place. A block is spread over its whole series.
    """
    n = F.col("n_rows")
    factor = F.when(n % SCATTER[0] != 0, SCATTER[0]).when(n % SCATTER[1] != 0, SCATTER[1]).otherwise(SCATTER[2])
    at = (F.col("rn") * (factor % n)) % n
    return rows.select(*keys, "label", "x", at.alias("_at"), F.floor(at * F.ceil(n / block_rows) / n).alias("_block"))


def permutation_hits(forest: Forest, rows: DataFrame, keys: Sequence[str], repeats: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(j, repeat, hits, n)``: rows predicted right with feature ``j`` shuffled; ``j`` is -1 for the rows as they are.

    A feature is shuffled among the rows of a block: the partner of place p is place p * a + c modulo the rows of the
    block, with a prime a above ``block_rows`` for each repeat. A row goes once to its block, whatever the number of features and
    repeats, and only counts leave it. Series of up to ``block_rows`` rows are one block.
    """
    if block_rows > PRIMES[0] or repeats > len(PRIMES):
        raise ValueError(f"at most {PRIMES[0]} rows a block and {len(PRIMES)} repeats")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        x, label, n = np.stack(pdf["x"].to_numpy()), pdf["label"].to_numpy(), len(pdf)
        paths = forest.paths(x)
        base = forest.value[np.arange(forest.trees), paths[-1]].sum(axis=1)
        out = [(-1, 0, int((base.argmax(axis=1) == label).sum()), n)]
        partners = np.array([(np.arange(n) * a + c) % n for c, a in enumerate(PRIMES[:repeats], 1)])
        for j in range(x.shape[1]):
            for repeat, more in enumerate(changed_predictions(forest, x, paths, j, x[partners, j])):
                out.append((j, repeat, int(((base + more).argmax(axis=1) == label).sum()), n))
        return pd.DataFrame(out, columns=["j", "repeat", "hits", "n"])

    counts = _blocks(rows, keys, block_rows).groupBy(*keys, "_block").applyInPandas(count, "j int, repeat int, hits long, n long")
    return counts.groupBy("j", "repeat").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def importance_of(hits: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(feature, perm_importance, perm_std)``: mean and deviation over the repeats of the accuracy lost."""
    rate = F.col("hits") / F.col("n")
    base = hits.where(F.col("j") < 0).select(rate.alias("_base"))
    lost = hits.where(F.col("j") >= 0).crossJoin(F.broadcast(base)).withColumn("loss", F.col("_base") - rate)  # base is one row
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    return lost.groupBy(feature.alias("feature")).agg(F.avg("loss").alias("perm_importance"), F.stddev_pop("loss").alias("perm_std"))


def permutation_importance(model: RandomForestClassificationModel, rows: DataFrame, names: Sequence[str],
                           keys: Sequence[str], repeats: int) -> DataFrame:
    """Accuracy lost when one feature is shuffled in its series, beside the importance of the splits."""
    spark = rows.sparkSession
    out = importance_of(permutation_hits(saved_forest(spark, model), rows, keys, repeats), names)
    gini = model.featureImportances.toArray()
    table = spark.createDataFrame([(n, float(g)) for n, g in zip(names, gini)], "feature string, gini_importance double")
    ranked = out.join(F.broadcast(table), "feature")  # a row per feature
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("perm_importance"), "feature")))


def global_importance(df: DataFrame, s: Series, trees: int = 200, depth: int = 8, repeats: int = 10) -> DataFrame:
    rows, names = training_rows(df, s)
    return permutation_importance(fit_forest(rows, trees, depth), rows, names, s.keys, repeats)


def per_regime_importance(df: DataFrame, s: Series, n_regimes: int = 3, trees: int = 100, depth: int = 6, repeats: int = 8) -> DataFrame:
    """One forest per regime against the rest."""
    rows, names = training_rows(df, s)
    out = None
    for r in range(n_regimes):
        binary = rows.withColumn("label", (F.col("label") == r).cast("double"))
        part = permutation_importance(fit_forest(binary, trees, depth), binary, names, s.keys, repeats).select(
            F.lit(r).alias("regime"), "feature", F.col("perm_importance").alias("importance"), F.col("perm_std").alias("std"),
            F.col("gini_importance").alias("gini"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def background_rows(rows: DataFrame, keys: Sequence[str], n: int) -> np.ndarray:
    """The ``n`` rows with the smallest hash of their key: what a switched-off feature is replaced from."""
    drawn = rows.select("x", F.xxhash64(*keys, "rn").alias("_h"), *keys, "rn").orderBy("_h", *keys, "rn").limit(n)
    return np.array([r["x"] for r in drawn.select("x").collect()], dtype=float)


def shapley_importance(df: DataFrame, s: Series, trees: int = 200, depth: int = 8, background: int = 100) -> DataFrame:
    """Mean and deviation of the absolute Shapley value per (regime, feature), over all rows.

    The values are exact for the forest against ``background`` rows (:func:`voltide.operators.forest.shapley_values`); a batch
    of rows gives one row of sums per regime and feature.
    """
    rows, names = training_rows(df, s)
    forest = saved_forest(rows.sparkSession, fit_forest(rows, trees, depth))
    against = background_rows(rows, s.keys, background)
    d = len(names)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regime, j = np.indices((forest.classes, d), dtype=np.int32).reshape(2, -1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            phi = np.abs(shapley_values(forest, x, against)).reshape(len(x), -1)
            n = np.full(len(j), len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (regime, j, n, phi.sum(axis=0), (phi * phi).sum(axis=0))], names=["regime", "j", "n", "s", "q"]
            )

    # a row costs a walk over all leaves, so a few files are dealt to all cores; more files than cores stay where they are
    cores, points = rows.sparkSession.sparkContext.defaultParallelism, rows.select("x")
    spread_out = points if points.rdd.getNumPartitions() >= cores else points.repartition(cores)
    sums = spread_out.mapInArrow(explain, "regime int, j int, n long, s double, q double").groupBy("regime", "j").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    mean = F.col("s") / F.col("n")
    feature = F.get(F.array(*[F.lit(n) for n in names]), F.col("j"))
    deviation = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("regime", feature.alias("feature"), mean.alias("mean_abs_shap"), deviation.alias("std_shap"))
