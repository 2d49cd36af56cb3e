"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import stored


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 ... n - 1 with edges a-b, each one's smallest reachable node."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the smallest node of the component.

    A round joins with the smallest neighbour, which is aggregated before the shuffle; every round is written to
    the shared folder. Large-star and small-star rounds need O(log n ** 2) rounds.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    seen = mark(e)
    for _ in range(limit):
        if not seen[0]:
            break
        # a star forest already: no node has two smaller neighbours, and no smaller neighbour has one itself
        if not e.groupBy("u").count().where("count > 1").limit(1).count() and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    one = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return one.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
