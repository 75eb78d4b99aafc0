"""k-means with all restarts, and all numbers of clusters, in the same passes.

A pass reads the rows once. Each task adds up, for every center of every fit that is still moving, the rows that are nearest to it; these
sums are all that is shuffled, and the centers made from them all that reaches the driver. First centers are drawn with chances in
proportion to the squared distance from those drawn before, by one pass per center: every row draws a waiting time for every fit, and the
shortest wins. So the number of jobs follows the slowest fit, not the number of fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4
#: Rows up to which one task searches alone.
LOCAL_ROWS = 65_536


@dataclass(frozen=True)
class Clusters:
    """Fitted centers (k, features) and the sum of squared distances to them."""

    centers: np.ndarray
    inertia: float

    def transform(self, df: DataFrame, features: str = "features", out: str = "cluster") -> DataFrame:
        """Adds the number of the nearest center, the first of equally near ones."""
        x = df.withColumn("_x", vector_to_array(features))
        apart = [" + ".join(f"power(_x[{j}] - ({float(v)!r}D), 2)" for j, v in enumerate(center)) for center in self.centers]
        x = x.withColumn("_apart", F.expr(f"array({', '.join(apart)})"))
        return x.withColumn(out, (F.array_position("_apart", F.array_min("_apart")) - 1).cast("int")).drop("_x", "_apart")


def points(vectors: DataFrame, features: str) -> DataFrame:
    """Rows as plain arrays ``x``, with a number ``draw`` that stands for each."""
    others = [c for c in vectors.columns if c != features]
    x = vector_to_array(features)
    return vectors.select(x.alias("x"), F.xxhash64(*others, x).alias("draw"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(0)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, (rows, centers)."""
    return np.maximum(((x[:, None, :] - centers[None]) ** 2).sum(2), 0.0) if len(centers) <= 64 else np.concatenate([_apart(x, c) for c in np.array_split(centers, len(centers) // 64 + 1)], 1)


def _waits(draw: np.ndarray, fit: int, turn: int, seed: int) -> np.ndarray:
    """Exponential waiting times, the same for a row, fit and turn in any run."""
    z = draw.view(np.uint64) + np.uint64((fit * 1_000_003 + turn * 7919 + seed * 104_729 + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)


def _draws(batches: Iterator[pa.RecordBatch], asked: list[int], given: dict[int, np.ndarray], turn: int, seeds: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Of every fit that asks, the row with the shortest wait."""
    best: dict[int, tuple[float, list[float]]] = {}
    for batch in batches:
        if not len(batch):
            continue
        x, draw = _matrix(batch), batch.column(1).to_numpy()
        for f in asked:
            wait = _waits(draw, f, turn, seeds[f])
            if turn:
                weight = _apart(x, given[f]).min(1)
                wait = np.divide(wait, weight, out=np.full(len(wait), np.inf), where=weight > 0)
            at = int(wait.argmin())
            if f not in best or (wait[at], x[at].tolist()) < best[f]:
                best[f] = float(wait[at]), x[at].tolist()
    if best:
        yield pa.RecordBatch.from_arrays([pa.array(list(best)), pa.array([w for w, _ in best.values()]), pa.array([x for _, x in best.values()])], ["fit", "wait", "x"])


def _sums(batches: Iterator[pa.RecordBatch], centers: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    totals = [np.zeros((len(c), c.shape[1] + 2)) for c in centers]
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch)
        for c, total in zip(centers, totals):
            apart = _apart(x, c)
            near = apart.argmin(1)
            total += (near == np.arange(len(c))[:, None]).astype(float) @ np.column_stack([x, np.ones(len(x)), apart[np.arange(len(x)), near]])
    flat = np.concatenate([t.ravel() for t in totals])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])


class Spread:
    """Passes over rows in a table, a job each."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def draws(self, *asked) -> dict[int, list[float]]:
        won = self.rows.mapInArrow(lambda batches: _draws(batches, *asked), "fit long, wait double, x array<double>")
        return {row["fit"]: row["x"] for row in won.groupBy("fit").agg(F.min(F.struct("wait", "x"))["x"].alias("x")).collect()}

    def sums(self, centers: Sequence[np.ndarray]) -> np.ndarray:
        rows = self.rows.mapInArrow(lambda batches: _sums(batches, centers), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        return np.array([row["value"] for row in sorted(rows, key=lambda row: row["place"])])


class Held:
    """The same passes over rows that a task holds."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.batches = batches

    def draws(self, *asked) -> dict[int, list[float]]:
        return {fit: x for won in _draws(iter(self.batches), *asked) for fit, x in zip(won.column(0).to_pylist(), won.column(2).to_pylist())}

    def sums(self, centers: Sequence[np.ndarray]) -> np.ndarray:
        return next(_sums(iter(self.batches), centers)).column(1).to_numpy()


def first_centers(source: Spread | Held, ks: Sequence[int], seeds: Sequence[int]) -> list[np.ndarray]:
    """Centers of every fit, drawn one after the other."""
    centers: list[list[np.ndarray]] = [[] for _ in ks]
    for turn in range(max(ks)):
        asked = [f for f, k in enumerate(ks) if k > turn]
        for fit, x in source.draws(asked, {f: np.array(centers[f]) for f in asked}, turn, seeds).items():
            centers[fit].append(np.array(x))
    return [np.array(c) for c in centers]


def nearest_sums(source: Spread | Held, centers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Of every fit (k, features + 2): sums of the rows nearest to each center, their number and their squared distances."""
    shapes = [(len(c), c.shape[1] + 2) for c in centers]
    ends = np.cumsum([k * d for k, d in shapes])
    return [part.reshape(shape) for part, shape in zip(np.split(source.sums(centers), ends[:-1]), shapes)]


def moved(centers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Means of the rows of each center; one without rows stays."""
    counts = sums[:, -2:-1]
    return np.where(counts > 0, np.divide(sums[:, :-2], counts, out=np.zeros_like(centers), where=counts > 0), centers)


def search(source: Spread | Held, ks: Sequence[int], n_init: int, max_iter: int, seed: int) -> list[Clusters]:
    every = [(k, seed + i) for k in ks for i in range(n_init)]
    centers = [np.unique(c, axis=0) for c in first_centers(source, [k for k, _ in every], [s for _, s in every])]
    open_ = list(range(len(every)))
    for _ in range(max_iter):
        still = []
        for f, sums in zip(open_, nearest_sums(source, [centers[f] for f in open_])):
            after = moved(centers[f], sums)
            if ((after - centers[f]) ** 2).sum(1).max() > TOLERANCE**2:
                still.append(f)
            centers[f] = after
        open_ = still
        if not open_:
            break
    inertia = [float(sums[:, -1].sum()) for sums in nearest_sums(source, centers)]
    best = [min((f for f, (of, _) in enumerate(every) if of == k), key=lambda f: (inertia[f], f)) for k in ks]
    return [Clusters(centers[f], inertia[f]) for f in best]


def fit_many(
    vectors: DataFrame, ks: Sequence[int], n_init: int, max_iter: int = 300, seed: int = 42, features: str = "features", local_rows: int = LOCAL_ROWS,
) -> list[Clusters]:
    """The best of ``n_init`` fits for each number of clusters. Fewer distinct rows than centers give fewer centers.

    Up to ``local_rows`` rows are searched by one task, more by a job per pass; the passes are the same.
    """
    rows, ks = points(vectors, features), list(ks)
    n = vectors.count()
    if not n:
        raise ValueError("no rows to cluster")
    if n > local_rows:
        return search(Spread(rows), ks, n_init, max_iter, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if held:
            found = search(Held(held), ks, n_init, max_iter, seed)
            columns = [pa.array(ks), pa.array([c.centers.ravel() for c in found]), pa.array([c.inertia for c in found])]
            yield pa.RecordBatch.from_arrays(columns, ["k", "centers", "inertia"])

    found = {row["k"]: row for row in rows.repartition(1).mapInArrow(run, "k long, centers array<double>, inertia double").collect()}
    width = len(rows.first()["x"])
    return [Clusters(np.array(found[k]["centers"]).reshape(-1, width), found[k]["inertia"]) for k in ks]
