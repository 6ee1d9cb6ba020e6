"""Connected components of a graph given by its edges, without gathering any node's neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

#: Edges that a task joins by itself.
TASK_EDGES = 1 << 19


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots): each node of the edges with the smallest node that they join it to.

    In each pass the larger root of an edge is hung on the smaller one; only roots without a smaller
    neighbour are left, at most half of them.
    """
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not (root[root] == root).all():
            root = root[root]


def _joined(most: int):
    """Replaces a partition's edges by those from its nodes to their roots, ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        def shrink() -> tuple[np.ndarray, np.ndarray]:
            nodes, roots = contract(u, v)
            return nodes[nodes != roots], roots[nodes != roots]

        for b in batches:
            u, v = np.concatenate([u, b.column(0).to_numpy()]), np.concatenate([v, b.column(1).to_numpy()])
            if len(u) > 2 * most:
                u, v = shrink()
                if len(u) > most:
                    yield out()
                    u = v = np.empty(0, np.int64)
        u, v = shrink()
        yield out()

    return run


def _star_round(held: DataFrame) -> DataFrame:
    """A large-star and a small-star step: a node hangs its larger, then its other neighbours on the smallest node it knows."""
    both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    small = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).filter("v <> m").distinct()
    return small.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _are_stars(held: DataFrame) -> bool:
    """Whether every node hangs on one other, on which nothing but such nodes hang."""
    ends = held.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(held.select(F.col("v").alias("node"), F.lit(0).alias("hangs")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least")).filter("hangs > 1 or (hangs = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, component)`` of every node in an edge; a component's name is its smallest node.

    Each task first joins what its own edges (``task_edges`` at a time) join.  If that took more than
    one task, rounds of star steps follow until only stars are left.  A step is an aggregate by node and a
    join with it, so a node with very many neighbours is combined before the shuffle and split by
    adaptive execution.
    """
    held = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u <> v"))
    while True:
        tasks = max(1, -(-held.count() // task_edges))
        before, joined = held, held.coalesce(tasks).mapInArrow(_joined(task_edges), "u long, v long")
        held = cut(joined if tasks == 1 else _star_round(joined))
        forget(before)
        if tasks == 1 or _are_stars(held):
            break
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
