"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.runtime import cut


EDGES, LEAST_TASKS = 20_000, 8  # edges of a task, and tasks of a shuffle


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of some edges that aren't the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root: each node that isn't the smallest of its component, and the smallest.

    Nodes are longs. Every round is cut by a checkpoint in the shared folder. Neighbourhoods are
    only aggregated, never gathered: the minimum is combined before the shuffle and joined back.
    Loops and repeated edges are allowed; an empty edge list gives no rows.

    What goes into a shuffle is dealt to as many tasks as its edges need, not to as many as the session has for large
    tables: a shuffle leaves files for each of its tasks, and those of all rounds lie on the disk together.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    def dealt(e: DataFrame) -> DataFrame:
        return e.coalesce(max(LEAST_TASKS, -(-seen[0] // EDGES)))

    edges = cut(tidy(edges.select(F.col(a).alias("hi"), F.col(b).alias("lo")).where("hi is not null and lo is not null")))
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = dealt(edges)
        # Large star: greater neighbours move to the least of a node and its neighbours.
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("o")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = dealt(tidy(dealt(both.join(least, "n").where("o > n").select(F.col("o").alias("hi"), F.col("m").alias("lo")))))
        # Small star: a node and its lesser neighbours move to the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo")))
        edges = cut(dealt(tidy(dealt(small))))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
