"""Connected components by alternating large-star and small-star steps.

Both steps only look at a node's smallest neighbour, which is a grouped minimum joined back to the edges.  The minima are
written down first: Spark splits a skewed join only where both sides come straight from a shuffle, and sends the minima to
all tasks instead where they measure small, so a node with very many neighbours is never one task's work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n nodes the node of least ``rank`` in its component under the links (i, j)."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    label = place.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[order[label]]
        if (label == before).all():
            break
    return order[label]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = stage(least, "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``edges(a, b)`` but the components' own least.

    Each round is written to the shared folder, which cuts the lineage; only a count and a checksum of the edges
    reach the driver.
    """
    current = stage(edges.select("a", "b").where("a != b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        current = stage(_small_star(stage(_large_star(current), "edges")), "edges")
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
