"""Gaussian hidden Markov model fitted by expectation-maximisation over blocks of rows.

A block of consecutive rows acts on the state distribution as one k x k matrix, so an exact pass over a long
series needs three steps: reduce every block to its matrix, scan the short table of blocks for what enters each
block from both sides, then run forward-backward (or backtrack the best path) inside the blocks in parallel.
Only sums of the size of the model reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltide.operators.cleaning import standardise
from voltide.operators.regime_models import K, SEED, feature_names, fit_kmeans, scaled_vectors
from voltide.operators.regime_rules import apply_label_rank
from voltide.plans.series import Series, with_row_index
from voltide.session import materialise

# features of this detector (fixed values)
FEATURES = ("log_return", "vol_60m", "vol_240m", "cum_return_60m", "return_skew_60m", "volume_spike", "bb_width", "atr_pct")
COVARIANCE_PRIOR = 1e-2
DOUBLES = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class GaussianHmm:
    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    loglik: float = float("-inf")

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for i, (mean, cov) in enumerate(zip(self.means, self.covariances)):
            root = np.linalg.cholesky(cov)
            z = np.linalg.solve(root, (x - mean).T)
            out[:, i] = -0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(root)).sum()
        return out


def pack_rows(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """``(keys, block, first, times, x)``: rows of a chunk in time order, x flattened row by row."""
    rows = with_row_index(df.select(*s.keys, s.time, *columns), s).withColumn("block", s.chunk())
    packed = rows.groupBy(*s.keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(s.time).alias("t"), F.array(*columns).alias("x")))).alias("_rows"),
        (F.min("rn") == 0).alias("first"),
    )
    return packed.select(
        *s.keys, "block", "first", F.transform("_rows", lambda r: r["t"]).alias("times"),
        F.flatten(F.transform("_rows", lambda r: r["x"])).alias("x"),
    )


def _matrix(row: dict, d: int) -> np.ndarray:
    return np.asarray(row["x"], float).reshape(-1, d)


def _scaled_density(model: GaussianHmm, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    logs = model.log_density(x)
    top = logs.max(axis=1)
    return np.exp(logs - top[:, None]), top


def block_matrix(model: GaussianHmm, x: np.ndarray, first: bool) -> np.ndarray:
    """The block as a matrix, scaled to maximum 1 (scales cancel in the posteriors)."""
    density, _ = _scaled_density(model, x)
    out = np.eye(len(model.means))
    for i, b in enumerate(density):
        out = (out if first and i == 0 else out @ model.transition) * b
        out /= max(out.max(), 1e-300)
    return out


def block_statistics(model: GaussianHmm, x: np.ndarray, first: bool, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Flat sums [start, transitions, weights, x sums, xx sums, log-likelihood] of one block."""
    k, (n, d) = len(model.means), x.shape
    density, top = _scaled_density(model, x)
    forward, scale = np.empty((n, k)), np.empty(n)
    prior = np.empty((n, k))
    a = alpha / alpha.sum()
    for i in range(n):
        prior[i] = a
        a = (a if first and i == 0 else a @ model.transition) * density[i]
        scale[i] = max(a.sum(), 1e-300)
        a = a / scale[i]
        forward[i] = a
    backward = np.empty((n, k))
    b = beta / beta.sum()
    for i in range(n - 1, -1, -1):
        backward[i] = b
        b = model.transition @ (density[i] * b)
        b = b / max(b.sum(), 1e-300)
    gamma = forward * backward
    gamma /= gamma.sum(axis=1, keepdims=True)
    pairs = prior[:, :, None] * model.transition[None] * (density * backward)[:, None, :]
    if first:
        pairs = pairs[1:]
    pairs = pairs / np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
    start = gamma[0] if first else np.zeros(k)
    second = np.einsum("nk,nd,ne->kde", gamma, x, x, optimize=True)
    loglik = np.log(scale).sum() + top.sum()
    return np.concatenate([start, pairs.sum(axis=0).ravel(), gamma.sum(axis=0), (gamma.T @ x).ravel(), second.ravel(), [loglik]])


def maximise(total: np.ndarray, k: int, d: int, diagonal: bool) -> GaussianHmm:
    """New parameters from the summed statistics."""
    start, rest = total[:k], total[k:]
    pairs, rest = rest[: k * k].reshape(k, k), rest[k * k:]
    weight, rest = np.maximum(rest[:k], 1e-10), rest[k:]
    means = rest[: k * d].reshape(k, d) / weight[:, None]
    second = rest[k * d: k * d + k * d * d].reshape(k, d, d)
    cov = second - weight[:, None, None] * means[:, :, None] * means[:, None, :]
    cov = (cov + COVARIANCE_PRIOR * np.eye(d)) / np.maximum(weight, 1.0)[:, None, None]
    if diagonal:
        cov = cov * np.eye(d)
    rows = pairs.sum(axis=1, keepdims=True)
    transition = np.where(rows > 0, pairs / np.maximum(rows, 1e-300), 1.0 / k)
    return GaussianHmm(start / start.sum(), transition, means, cov, float(total[-1]))


def _schema(blocks: DataFrame, s: Series, *more: T.StructField) -> T.StructType:
    return T.StructType([*[blocks.schema[c] for c in (*s.keys, "block")], *more])


def _entering(blocks: DataFrame, s: Series, model: GaussianHmm, d: int) -> DataFrame:
    """Blocks with the distribution entering from the left and the likelihood vector from the right."""
    keys, k = list(s.keys), len(model.means)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = [[*[r[c] for c in keys], r["block"], block_matrix(model, _matrix(r, d), r["first"]).ravel()] for r in rows]
            yield pd.DataFrame(out, columns=[*keys, "block", "m"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        matrices = [np.asarray(m).reshape(k, k) for m in pdf["m"]]
        alphas, a = [], model.start
        for m in matrices:
            alphas.append(a)
            a = a @ m
            a = a / max(a.sum(), 1e-300)
        betas, b = [], np.ones(k)
        for m in reversed(matrices):
            betas.append(b)
            b = m @ b
            b = b / max(b.max(), 1e-300)
        return pdf[[*keys, "block"]].assign(alpha=alphas, beta=betas[::-1])

    reduced = blocks.mapInPandas(reduce, _schema(blocks, s, T.StructField("m", DOUBLES)))
    ends = reduced.groupBy(*keys).applyInPandas(
        scan, _schema(blocks, s, T.StructField("alpha", DOUBLES), T.StructField("beta", DOUBLES))
    )
    return blocks.join(ends, [*keys, "block"])


def expectation(blocks: DataFrame, s: Series, model: GaussianHmm, d: int, single: bool) -> np.ndarray:
    """Statistics of all blocks summed. ``single``: no series has a second block, so nothing enters."""
    k = len(model.means)
    if single:
        work = blocks.withColumns(
            {"alpha": F.array(*[F.lit(float(v)) for v in model.start]), "beta": F.array(*[F.lit(1.0)] * k)}
        )
    else:
        work = _entering(blocks, s, model, d)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                part = block_statistics(model, _matrix(r, d), r["first"], np.asarray(r["alpha"]), np.asarray(r["beta"]))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    summed = work.mapInPandas(collect, T.StructType([T.StructField("sums", DOUBLES)]))
    rows = summed.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    total = np.empty(len(rows))
    for r in rows:
        total[r["pos"]] = r["v"]
    return total


def fit_hmm(blocks: DataFrame, s: Series, initial_means: np.ndarray, n_iter: int = 100, tol: float = 1e-2) -> GaussianHmm:
    """EM from given means; full covariances, or diagonal ones if a full covariance degenerates."""
    k, d = initial_means.shape
    most = blocks.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    for diagonal in (False, True):
        model = GaussianHmm(np.full(k, 1 / k), np.full((k, k), 1 / k), initial_means, np.array([np.eye(d)] * k))
        before = float("-inf")
        try:
            for _ in range(n_iter):
                model = maximise(expectation(blocks, s, model, d, most == 1), k, d, diagonal)
                np.linalg.cholesky(model.covariances)
                if model.loglik - before < tol:
                    break
                before = model.loglik
            return model
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the covariances degenerate even in diagonal form")


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def best_path(blocks: DataFrame, s: Series, model: GaussianHmm, d: int) -> DataFrame:
    """Most likely state of every row, ``(keys, time, state)``, by the same three steps in max-plus algebra."""
    keys, k = list(s.keys), len(model.means)
    moves = _log(model.transition)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                score = np.where(np.eye(k) > 0, 0.0, -np.inf)
                for i, b in enumerate(model.log_density(_matrix(r, d))):
                    step = score if r["first"] and i == 0 else (score[:, :, None] + moves[None]).max(axis=1)
                    score = step + b
                out.append([*[r[c] for c in keys], r["block"], score.ravel()])
            yield pd.DataFrame(out, columns=[*keys, "block", "m"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        matrices = [np.asarray(m).reshape(k, k) for m in pdf["m"]]
        entering, v = [], _log(model.start)
        for m in matrices:
            entering.append(v)
            v = (v[:, None] + m).max(axis=0)
        last, out = int(np.argmax(v)), []
        for v, m in zip(reversed(entering), reversed(matrices)):
            come = int(np.argmax(v + m[:, last]))
            out.append((come, last))
            last = come
        out.reverse()
        return pdf[[*keys, "block"]].assign(come=[a for a, _ in out], leave=[b for _, b in out])

    path_schema = T.StructType(
        [*[blocks.schema[c] for c in keys], T.StructField("times", blocks.schema["times"].dataType),
         T.StructField("states", T.ArrayType(T.IntegerType()))]
    )

    def backtrack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                density = model.log_density(_matrix(r, d))
                came = np.empty((len(density), k), dtype=int)
                score = np.full(k, -np.inf)
                score[r["come"]] = 0.0
                for i, b in enumerate(density):
                    if r["first"] and i == 0:
                        came[i], score = np.arange(k), score + b
                        continue
                    step = score[:, None] + moves
                    came[i] = step.argmax(axis=0)
                    score = step.max(axis=0) + b
                states = [r["leave"]]
                for i in range(len(density) - 1, 0, -1):
                    states.append(int(came[i, states[-1]]))
                out.append([*[r[c] for c in keys], r["times"], states[::-1]])
            yield pd.DataFrame(out, columns=[*keys, "times", "states"])

    reduced = blocks.mapInPandas(reduce, _schema(blocks, s, T.StructField("m", DOUBLES)))
    limits = reduced.groupBy(*keys).applyInPandas(
        ends, _schema(blocks, s, T.StructField("come", T.IntegerType()), T.StructField("leave", T.IntegerType()))
    )
    paths = blocks.join(limits, [*keys, "block"]).mapInPandas(backtrack, path_schema)
    each = paths.select(*keys, F.explode(F.arrays_zip("times", "states")).alias("_z"))
    return each.select(*keys, F.col("_z.times").alias(s.time), F.col("_z.states").alias("state"))


def regime_hmm(df: DataFrame, s: Series, k: int = K, n_iter: int = 100, tol: float = 1e-2) -> tuple[DataFrame, GaussianHmm]:
    """Viterbi labels ranked by mean volatility, and the model (its transition matrix is ``model.transition``)."""
    names = feature_names(df.columns, FEATURES)
    z = [f"z_{c}" for c in names]
    start = fit_kmeans(scaled_vectors(df, names, s), k, n_init=1, seed=SEED)
    blocks = materialise(pack_rows(standardise(df, names, s.keys), s, z), "hmm_blocks")
    model = fit_hmm(blocks, s, start.centers, n_iter, tol)
    labelled = df.join(best_path(blocks, s, model, len(z)), [*s.keys, s.time])
    return apply_label_rank(labelled, "state", "vol_60m", s.keys, k), model
