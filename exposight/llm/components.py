"""Connected components of an edge table by alternating large-star and small-star steps.

A step is a group-minimum and a join; before it each task joins what its own edges join, so few rounds are left.  Every round is
written to the shared folder, so lineage stays short and nothing about the graph reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import drop, materialize

#: Edges that one task takes at once, about 2 MB.
AT_ONCE = 100_000


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges, in order, and the least node each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        for end in (one, two):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)  # the roots too, so that whole trees move
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of the task's edges and the least one it reaches by them, itself for that one."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = least_reachable(*(np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((a, "a"), (b, "b"))))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v): every u meets its neighbours v; links them to the least of them all."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def _unsettled(edges: DataFrame) -> int:
    """Nodes with more than one parent, or with a parent and children: none where every component is a star around its least node."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable.  Nodes without edges are not listed.

    Loops and repeated edges are harmless; rows with a null end are no edges.  No edges: empty result.
    """
    ends = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter(f"{a} is not null and {b} is not null and a <> b")
    cur = materialize(ends, "edges")
    while True:
        tasks = -(-cur.count() // AT_ONCE)
        joined = cur.coalesce(max(tasks, 1)).mapInArrow(_forest, "a long, b long")
        if tasks <= 1:
            return joined.select(F.col("a").alias("node"), F.col("b").alias("component"))
        nxt = materialize(joined.filter("a <> b").distinct(), "edges")
        drop(cur)
        cur = nxt
        if not _unsettled(cur):
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        starred = _star(both, True).distinct()
        nxt = materialize(_star(starred.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct(), "edges")
        drop(cur)
        cur = nxt
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
