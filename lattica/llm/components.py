"""Connected components of link tables, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_counted, materialise


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (step := root[root] != root).any():
            root[step] = root[root[step]]
        if (root == before).all():
            break
    return root


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Alternating star contractions: each node's larger neighbours, then all its smaller ones, are linked to the
    smallest node known. Minima are combined before they are shuffled, and those of nodes with many links are
    broadcast, so that no hub's links meet in one task; every round is written to the shared folder and replaces the
    one before. Null ends are dropped, repeated links and loops are harmless, no links give no rows.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    smallest = lambda x: materialise(x.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = smallest(both)
        least = first.select("a", F.least("a", "m").alias("m"), "n")
        large = join_counted(both, least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct())
        second = smallest(large)
        moved = join_counted(large, second, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, links = links, materialise(moved.unionByName(second.select("a", F.col("m").alias("b"))).distinct())
        drop(before, first, large, second)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
