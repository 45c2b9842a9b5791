"""Connected components by alternating small and large stars (Kiveris et al., 2014), over links that tasks have contracted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace
from .textblocks import returns_memory

#: A task contracts so many links at a time (some 100 bytes each).
CHUNK = 1 << 20


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of some links, and the least vertex of each one's component among these links."""
    vertices, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(vertices))
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            return vertices, vertices[parent]
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above


@returns_memory
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of vertices to the least one that they reach by CHUNK of a task's links."""

    def chunk(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        v, least = least_members(*(np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in some]) for c in ("a", "b")))
        other = v != least
        return pa.record_batch([pa.array(v[other]), pa.array(least[other])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            yield chunk(held)
            held, n = [], 0
    if n:
        yield chunk(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or not larger) neighbours to the least of its neighbourhood."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    out = joined.where(F.col("b") > F.col("a")) if large else joined
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def _flat(edges: DataFrame) -> bool:
    """Whether each vertex either has one link down or is one that links lead down to."""
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("down")).unionAll(edges.select(F.col("b").alias("v"), F.lit(None).cast("long").alias("down")))
    ends = ends.groupBy("v").agg(F.min("down").alias("one"), F.max("down").alias("other"), F.max(F.col("down").isNull()).alias("root"))
    return not ends.agg(F.max(F.expr("one is not null and (root or one <> other)")).alias("deep")).first().deep


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (a, b), component being its least vertex.

    Each round is a written table, so a lost executor repeats one round at most. No vertex's
    neighbours are gathered: minima are partial sums, and the join back may be split.
    """
    now, k = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), 0
    while True:
        # contracted links are stars already: small stars join their centres, then large ones flatten
        now = work.save(_star(_star(now.mapInArrow(_contracted, "a long, b long"), False), True).distinct(), f"{name}-{k}")
        if k:
            work.drop(f"{name}-{k - 1}")
        if _flat(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        k += 1
