"""A fitted forest as flat arrays, for tasks that explain its predictions with NumPy.

The arrays have a place for every node of every tree, so their size follows from the number of trees and their depth
and not from the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voltide.session import scratch_path

SLICE = 512  # rows worked on at once


@dataclass(frozen=True)
class Forest:
    """``[tree, node]`` arrays; ``feature`` is -1 at a leaf, rows with ``x <= threshold`` go left, the root is node 0.

    ``value`` holds the class shares of each node; the prediction of the forest is their mean over the trees.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    @property
    def classes(self) -> int:
        return self.value.shape[2]

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Nodes that each row passes in each tree, ``[step, row, tree]``; a leaf is repeated."""
        tree = np.arange(self.trees)
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), self.trees), dtype=np.int32)
        steps = [node]
        while True:
            feature = self.feature[tree, node]
            if (feature < 0).all():
                return np.stack(steps)
            low = x[row, np.maximum(feature, 0)] <= self.threshold[tree, node]
            below = np.where(low, self.left[tree, node], self.right[tree, node])
            node = np.where(feature < 0, node, below)
            steps.append(node)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, ``[row, class]``."""
        leaf = self.paths(x)[-1]
        return self.value[np.arange(self.trees), leaf].mean(axis=1)


def saved_forest(spark: SparkSession, model: RandomForestClassificationModel) -> Forest:
    """The trees of a fitted model, read from its saved form (at most trees x 2^(depth + 1) nodes)."""
    path = scratch_path(spark, "forest")
    model.save(path)
    node = F.col("nodeData")
    cut = node["split"]
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        cut["featureIndex"].alias("feature"), F.get(cut["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["impurityStats"].alias("stats"),
    ).toPandas()
    shape = (int(nodes["treeID"].max()) + 1, int(nodes["id"].max()) + 1)
    at = (nodes["treeID"].to_numpy(), nodes["id"].to_numpy())

    def spread(column: str, dtype: type) -> np.ndarray:
        out = np.full(shape, -1, dtype=dtype)
        out[at] = nodes[column]
        return out

    stats = np.stack(nodes["stats"].to_numpy())
    value = np.zeros((*shape, stats.shape[1]))
    value[at] = stats / stats.sum(axis=1, keepdims=True)
    left = spread("left", np.int32)
    feature = np.where(left < 0, -1, spread("feature", np.int32))
    return Forest(feature, spread("threshold", float), left, spread("right", np.int32), value)


# permutation -----------------------------------------------------------------------------------
def changed_predictions(forest: Forest, x: np.ndarray, paths: np.ndarray, j: int, columns: np.ndarray) -> Iterator[np.ndarray]:
    """What each row of ``columns`` in the place of feature ``j`` adds to the summed shares of the trees, ``[row, class]``.

    Only trees whose path of a row asks for ``j`` are walked again, from the first node that asks.
    """
    tree = np.arange(forest.trees)
    asks = forest.feature[tree, paths] == j
    row, of_tree = np.nonzero(asks.any(axis=0))
    first = paths[asks[:, row, of_tree].argmax(axis=0), row, of_tree]
    old = forest.value[of_tree, paths[-1, row, of_tree]]
    for column in columns:
        node = first
        while True:
            feature = forest.feature[of_tree, node]
            if (feature < 0).all():
                break
            seen = np.where(feature == j, column[row], x[row, np.maximum(feature, 0)])
            below = np.where(seen <= forest.threshold[of_tree, node], forest.left[of_tree, node], forest.right[of_tree, node])
            node = np.where(feature < 0, node, below)
        gain = forest.value[of_tree, node] - old
        yield np.stack([np.bincount(row, g, minlength=len(x)) for g in gain.T], axis=1)


# Shapley values --------------------------------------------------------------------------------
@dataclass(frozen=True)
class Boxes:
    """Leaves of one tree as boxes: leaf ``l`` asks ``low < x[feature] <= high`` for each of its places."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def misses(self, x: np.ndarray) -> np.ndarray:
        """Bits of the places at which a row is outside of a leaf, ``[row, leaf]``."""
        out = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for place in range(self.feature.shape[1]):
            seen = x[:, self.feature[:, place]]
            out |= ((seen <= self.low[:, place]) | (seen > self.high[:, place])).astype(np.int64) << place
        return out


def boxes(forest: Forest, tree: int) -> Boxes:
    found, open_nodes = [], [(0, {})]
    while open_nodes:
        node, box = open_nodes.pop()
        j, t = int(forest.feature[tree, node]), float(forest.threshold[tree, node])
        if j < 0:
            found.append((box, forest.value[tree, node]))
            continue
        low, high = box.get(j, (-np.inf, np.inf))
        open_nodes.append((int(forest.left[tree, node]), box | {j: (low, min(high, t))}))
        open_nodes.append((int(forest.right[tree, node]), box | {j: (max(low, t), high)}))
    shape = (len(found), max(len(box) for box, _ in found))
    feature, low, high = np.zeros(shape, dtype=np.int64), np.full(shape, -np.inf), np.full(shape, np.inf)
    for leaf, (box, _) in enumerate(found):
        for place, (j, (a, b)) in enumerate(box.items()):
            feature[leaf, place], low[leaf, place], high[leaf, place] = j, a, b
    return Boxes(feature, low, high, np.array([v for _, v in found]))


def credits(tree: Boxes, background: np.ndarray) -> np.ndarray:
    """Share of a leaf's value that each of its places earns a row, by the row's misses: ``[leaf, misses, place]``.

    Against one background row a leaf counts if no place is missed by both. Let a places be missed by the background row
    only and b by the row only. The leaf is reached once all a are switched to the row and none of the b is, so over all
    orders of switching one of the a earns (a-1)! b! / (a+b)! and one of the b loses a! (b-1)! / (a+b)!. Background rows
    with the same misses are one; sums over subsets of misses serve all of them.
    """
    leaves, places = tree.feature.shape
    full = (1 << places) - 1
    bits = np.array([m.bit_count() for m in range(full + 1)])
    counts = np.zeros((leaves, full + 1))
    np.add.at(counts, (np.arange(leaves)[None, :], tree.misses(background)), 1 / len(background))
    within = np.where(bits[None, None, :] == np.arange(places + 1)[:, None, None], counts[None], 0.0)
    for place in range(places):
        has = np.flatnonzero(np.arange(full + 1) >> place & 1)
        within[:, :, has] += within[:, :, has ^ (1 << place)]
    f = [float(factorial(i)) for i in range(2 * places + 1)]
    wins = np.array([[f[a - 1] * f[b] / f[a + b] if a else 0.0 for b in range(places + 1)] for a in range(places + 1)])
    loses = np.array([[f[a] * f[b - 1] / f[a + b] if b else 0.0 for b in range(places + 1)] for a in range(places + 1)])
    missed = np.arange(full + 1)
    rest = full ^ missed
    lost = -(within[:, :, rest] * loses[:, bits][:, None, :]).sum(axis=0)
    out = np.empty((leaves, full + 1, places))
    for place in range(places):
        with_place = within[:, :, rest] - within[:, :, rest & ~(1 << place)]
        won = (with_place * wins[:, bits][:, None, :]).sum(axis=0)
        out[:, :, place] = np.where(missed >> place & 1, lost, won)
    return out


def shapley_values(forest: Forest, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact Shapley values of every row against the background rows, ``[row, class, feature]``.

    Their sum over the features is the row's prediction less the mean prediction of the background. A tree needs
    leaves x 2^places x places doubles for its credits, places being the different features of a path (at most its depth).
    """
    (n, d), k = x.shape, forest.classes
    out = np.zeros((n, k, d))
    for t in range(forest.trees):
        tree = boxes(forest, t)
        leaves, places = tree.feature.shape
        if not places:
            continue
        table = credits(tree, background)
        to = np.zeros((leaves, places, k, d))
        np.put_along_axis(to, tree.feature[:, :, None, None], tree.value[:, None, :, None], axis=3)
        to = to.reshape(leaves * places, k * d)
        for i in range(0, n, SLICE):
            part = x[i:i + SLICE]
            earned = table[np.arange(leaves)[None, :], tree.misses(part)].reshape(len(part), -1)
            out[i:i + SLICE] += (earned @ to).reshape(len(part), k, d)
    return out / forest.trees
