"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spooled, stored


def _between(a: str, b: str) -> tuple:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``edges (a BIGINT, b BIGINT)``: the smallest node it
    is connected to, itself included.

    Each round hooks every node to its smallest neighbour, follows two such hooks, and
    replaces the ends of all edges; edges inside one node vanish. Every node but a local
    minimum goes in each round, so rounds grow with the logarithm of the longest path.
    Minima are taken before the shuffle, and the side of a join that a hub can swell is
    always one that Spark may split. Nothing reaches the driver but how many edges are left.
    """
    left = spooled(edges.filter("a != b").select(*_between("a", "b")).distinct())
    labels, nodes = None, 0
    while n := left.count():
        nodes = nodes or 2 * n
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), 2 * n)
        hook = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
        up = stored(up.join(hook, "label").select("node", F.col("above").alias("label")), 2 * n)
        ends = left.join(up.select(F.col("node").alias("a"), F.col("label").alias("c")), "a").select("b", "c")
        ends = ends.join(up.select(F.col("node").alias("b"), F.col("label").alias("d")), "b")
        left = stored(ends.filter("c != d").select(*_between("c", "d")).distinct(), n)
        if labels is None:
            labels = up
        else:
            above = up.select(F.col("node").alias("label"), F.col("label").alias("above"))
            labels = stored(labels.join(above, "label", "left").select("node", F.coalesce("above", "label").alias("label")), nodes)
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and edges (a, b) in memory: the smallest node connected to each."""
    up = np.arange(n)
    while len(a):
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, higher := up[up]):
            up = higher
    return up
