"""Connected components of an edge table, by alternating stars.

Each round gives every node's larger neighbours its smallest neighbour, then its smaller ones. Both
steps are a minimum per node, combined before the shuffle, and a join back to the edges, whose hot
keys adaptive execution splits; no neighbourhood is gathered. Every round is written to the shared
folder, and rounds end when the edges stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import durable


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of the nodes 0 to n - 1, for edges within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
        if (root == before).all():
            return root


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect the larger (or the other) neighbours of each node with its smallest neighbour."""
    pairs = edges.select("a", "b")
    if larger:
        pairs = pairs.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    joined = pairs.join(least, pairs["a"] == least["node"])
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge in ``a, b``; the root is the smallest node."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = durable(ordered.distinct()), None
    while True:
        now = durable(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
