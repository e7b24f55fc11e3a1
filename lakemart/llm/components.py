"""Connected components of a graph kept as a table of edges.

Edges are first contracted inside each task to a star per local component, so a hot
node sends at most one edge per task and neighbour. Rounds of large-star and small-star
steps follow: every node links its neighbours to the smallest node it knows of. Both
steps are a minimum per node (summed up before the shuffle) and a join whose hot nodes
adaptive execution can split, so no neighbourhood is gathered anywhere. Each round is written to the shared checkpoint
folder; the driver only sees whether the round changed anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakemart.llm.common import by_value, tidy_after, written

by_value(__name__)

CONTRACT_ROWS = 500_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indices over the pairs ``a[i], b[i]``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as fewer edges: each node to the smallest one it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(at[: len(u)], at[len(u) :], len(nodes))
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v, contracted within each task; loops and null ends go."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            u = np.concatenate([u, batch.column(0).to_numpy()])
            v = np.concatenate([v, batch.column(1).to_numpy()])
            if len(u) > CONTRACT_ROWS:
                u, v = stars(u, v)
                if len(u) > CONTRACT_ROWS // 2:  # little left to contract: pass on
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                    u, v = u[:0], v[:0]
        u, v = stars(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    proper = edges.where("u is not null and v is not null and u != v")
    return proper.mapInArrow(tidy_after(contract), "u bigint, v bigint").where("u is not null")


def per_node(edges: DataFrame, *values: Column) -> DataFrame:
    """Aggregates per node ``u``, grouped by a hash next to it.

    So the result is not partitioned by the node yet and is shuffled (one row per node)
    for the join that follows: only then can adaptive execution split a hot node's edges.
    """
    return edges.groupBy("u", F.xxhash64("u", F.lit(0)).alias("spread")).agg(*values).drop("spread")


def large_star(edges: DataFrame) -> DataFrame:
    """Of a node's neighbours, the larger ones go to the smallest (or to the node itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = per_node(both, F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.where("u != v").distinct()


def small_star(large: DataFrame) -> DataFrame:
    """Of a node's neighbours, the smaller ones and the node go to the smallest."""
    low = per_node(large, F.min("v").alias("m"), F.count("*").alias("n"))
    up = large.join(low.where("n > 1"), "u").where("v != m")
    return low.select("u", F.col("m").alias("v")).union(
        up.select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def connected_components(
    edges: DataFrame, label: str = "components", rounds: int = 60, stars_already: bool = False
) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it can reach.

    ``edges`` has two bigint columns ``u`` and ``v``. Direction, repeats, loops and null
    ends don't matter. No edges give an empty table. ``stars_already`` says that the
    tasks that make the edges have contracted them.
    """
    edges = edges.select("u", "v")
    edges = edges.where("u != v") if stars_already else contracted(edges)
    now = written(edges, label)
    for _ in range(rounds):
        small = small_star(large_star(now))
        after = written(small.distinct(), label)
        # done when every node hangs on a root: no node is both below and above
        open_ = after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        twice = after.groupBy("u").count().where("count > 1")
        now = after
        if open_.isEmpty() and twice.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
