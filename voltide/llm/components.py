"""Connected components of a graph held in a DataFrame, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.session import materialise


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b); a component is named by its smallest node.

    In each round every node moves to its smallest neighbour, and on to where that one moves, and the graph of those that moved
    together is what is left. So a chain is halved in each round, and the rounds grow with the logarithm of its length. Nothing but the count of edges left reaches the driver. Each round is written to the shared folder, so a lost
    executor loses nothing. Edges from a node to itself are allowed and keep it in the result; null nodes are left out.
    """
    edges = materialise(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), f"{name}-edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        moves = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("at"), F.least("a", "b").alias("via")), f"{name}-moves")
        on = moves.select(F.col("at").alias("stop"), F.col("via").alias("to"))
        to = materialise(moves.join(on, moves.via == on.stop).select("at", "to"), f"{name}-moves")
        if labels is None:
            labels = to.select(F.col("at").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(to, labels.component == to.at, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels, f"{name}-labels")
        first = edges.join(to, edges.a == to.at).select(F.col("to").alias("a"), "b")
        left = first.join(to, first.b == to.at).select("a", F.col("to").alias("b")).where("a <> b").distinct()
        edges = materialise(left, f"{name}-edges")
        if edges.isEmpty():
            return labels
