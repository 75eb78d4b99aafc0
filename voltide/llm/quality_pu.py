"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives; other web text is unlabelled, a mixture of good and bad. With the share of good documents
(the class prior) the risk of a classifier can be written without a single negative example. The unbiased form goes below zero when a
flexible model overfits, so its negative part is held at zero or above (non-negative risk).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voltide.llm import measures
from voltide.llm.arrays import Texts, map_texts, parts

#: Most documents of either kind that a fit reads, chosen by a hash of the id.
FIT_ROWS = 10_000
HIDDEN, STEPS, RATE, DECAY = 16, 600, 0.02, 1e-4


@dataclass(frozen=True)
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]  # w1, b1, w2, b2


def features(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bounded or logarithmic features of the measurements, one row per text; all zero for a text without words."""
    m = {name: values.astype(float) for name, values in m.items()}
    words, lines, size = (np.maximum(1.0, m[name]) for name in ("n_words", "n_lines", "n_bytes"))
    letters = np.maximum(1.0, m["n_upper"] + m["n_lower"])
    columns = [
        np.log1p(m["n_words"]), np.log1p(m["n_lines"]), m["word_chars"] / words, np.log1p(m["longest_word"]),
        np.minimum(1.0, m["n_symbols"] / words), np.sqrt(np.minimum(1.0, m["n_marks"] / words)), m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words, m["n_twin_words"] / words, m["n_distinct_words"] / words, m["n_upper"] / letters,
        m["n_digits"] / size, letters / size, m["n_bytes"] / np.maximum(1.0, m["word_chars"]) / 4,
    ]
    return np.where((m["n_words"] > 0)[:, None], np.stack(columns, 1), 0.0)


def _forward(x: np.ndarray, w1, b1, w2, b2) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w1 + b1)
    return hidden, (hidden @ w2 + b2)[:, 0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 5) -> Model:
    """Minimise ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` under logistic loss, by Adam over whole samples.

    Where the second part is below zero, the step goes up its slope instead, as the non-negative estimator prescribes.
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    layers = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]

    def slope(x: np.ndarray, hidden: np.ndarray, by_output: np.ndarray) -> list[np.ndarray]:
        back = (by_output[:, None] @ layers[2].T) * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ by_output[:, None], by_output.sum(keepdims=True)]

    for step in range(1, STEPS + 1):
        (hp, gp), (hu, gu) = _forward(p, *layers), _forward(u, *layers)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up_p, up_u = _sigmoid(gp) / len(p), _sigmoid(gu) / len(u)  # slopes of the loss of calling a document bad
        if negative >= 0:
            parts = slope(p, hp, prior * (_sigmoid(gp) - 1) / len(p) - prior * up_p), slope(u, hu, up_u)
        else:
            parts = slope(p, hp, prior * up_p), slope(u, hu, -up_u)
        for k, (a, b) in enumerate(zip(*parts)):
            grad = a + b + DECAY * layers[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(prior), mean, scale, tuple(layers))


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, x array<double>"
    return map_texts(rows, "_text", schema, lambda part, texts: [part.column(0), list(features(measures.measured(texts)))])


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    prior: float | None = None, fit_rows: int = FIT_ROWS,
) -> Model:
    """Model from the texts of ``docs`` and the rows of ``labels`` (id, label) whose label is 1; docs without a label are unlabelled.

    ``prior`` is the share of good documents in the unlabelled text; if not given it is estimated as their share among labelled
    rows. Labels other than 1 serve for that share only and null labels for nothing. At most about ``fit_rows`` positives and as many
    unlabelled documents are read, chosen by a hash of the id, and only their features (14 numbers each) reach the driver. Without
    positives or without unlabelled text there is nothing to learn and every document scores ``prior`` (0.5 if unknown).
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_of")).agg(F.max(label_col).alias("_mark"))
    ids = docs.select(F.col(id_col).alias("_of")).join(marks, "_of", "left")
    counts = ids.agg(
        F.count(F.when(F.col("_mark") == 1, 1)).alias("good"), F.count("_mark").alias("known"), F.count(F.when(F.col("_mark").isNull(), 1)).alias("rest")
    ).first()
    if prior is None:
        prior = counts.good / counts.known if counts.known else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    if not counts.good or not counts.rest:
        d = len(features({name: np.zeros(1) for name in measures.NAMES})[0])
        flat = (np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.array([np.log(prior / (1 - prior))]))
        return Model(prior, np.zeros(d), np.ones(d), flat)
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("_of"), F.col("_mark")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("_mark") == 1, F.lit(fit_rows / counts.good)).otherwise(F.lit(fit_rows / counts.rest))
    chosen = ids.where((F.col("_mark").isNull() | (F.col("_mark") == 1)) & (draw < share)).dropDuplicates(["_of"])
    slim = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    rows = slim.join(F.broadcast(chosen), "_of").select(F.col("_mark").isNotNull().cast("int").alias("_id"), "_text")
    got = _measured(rows, "_id", "_text").toPandas()
    x, good = np.array(got["x"].tolist()), got["_id"].to_numpy() == 1
    order = np.lexsort(x.T)  # the result must not depend on the order of partitions
    x, good = x[order], good[order]
    return train(x[good], x[~good], prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``score`` (0 to 1, higher is better) and ``predicted`` (1 if the score is 0.5 or more).

    The whole text is read; a null or empty one gets the score of a text without words. Equal texts score alike. Memory follows the
    longest text; the model is a few hundred numbers and travels with the task.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(docs.dtypes)[id_col]}, score double"
    scored = map_texts(rows, "_text", schema, lambda part, texts: [part.column(0), _scores(model, texts)])
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(model: Model, texts: Texts) -> np.ndarray:
    return _sigmoid(_forward((features(measures.measured(texts)) - model.mean) / model.scale, *model.layers)[1])


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"))
    fields = StructType([*rows.schema, StructField("score", DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(0).flatten()[at]], ["row", "text"])
            for part, texts in parts(whole, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, texts))], fields.names)

    return rows.mapInArrow(run, fields).where("score >= 0.5").select("row.*")
