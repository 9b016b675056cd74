"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posetrail.llm.shared import free, stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (large) or smaller-or-equal (small) neighbours to the smallest node that it knows."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = out.where(F.col("a") != F.col("b"))
    return out if large else out.distinct()  # repeated edges do no harm in between


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the smallest node reachable.

    The minimum of each node is aggregated before the shuffle and only equi-joins follow, so a node with very many edges is
    spread by adaptive skew joins. An iteration is written to the shared folder. Self-loops are ignored; no edges, no rows.
    """
    now = stash(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        last, now = now, stash(_star(_star(now, large=True), large=False), "edges")
        free(last)
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())


def spanning_edges(groups: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of edges (i, j) between nodes that connect what all the edges do; nodes of equal ``groups`` count as connected."""
    _, label = np.unique(groups, return_inverse=True)
    at, chosen = np.arange(len(i)), []
    while len(at := at[label[i[at]] != label[j[at]]]):
        x, y = label[i[at]], label[j[at]]
        pick = np.full(len(groups), len(at))
        np.minimum.at(pick, x, np.arange(len(at)))
        np.minimum.at(pick, y, np.arange(len(at)))
        picked = np.unique(pick[pick < len(at)])
        chosen.append(at[picked])
        root = np.arange(len(groups))
        while True:
            low = np.minimum(root[x[picked]], root[y[picked]])
            new = root.copy()
            np.minimum.at(new, x[picked], low)
            np.minimum.at(new, y[picked], low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        label = root[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)
