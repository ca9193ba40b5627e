"""Union-find grouping: connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import drop, save


def label(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each node's component, for nodes 0..n-1 and edges a-b (hooking to minima and pointer jumping)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        go = x != y
        if not go.any():
            break
        a, b, x, y = a[go], b[go], x[go], y[go]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
    if a and sum(map(len, a)):
        a, b = np.concatenate(a), np.concatenate(b)
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = label(at[: len(a)], at[len(a) :], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["node", "root"])


def components(edges: DataFrame, one_task_edges: int = 4_000_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (two bigint columns): root is the least node of its component.

    Up to ``one_task_edges`` edges one task labels them in memory (64 MB of ids); beyond that, alternating
    large-star and small-star rounds, each a distributed job whose result is written to the shared folder.
    Nulls are ignored; an empty table gives no rows."""
    a, b = edges.columns[:2]
    edges = save(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null").distinct(), "edges")
    n = edges.count()
    if n <= one_task_edges:
        return edges.coalesce(1).mapInArrow(_one_task, "node bigint, root bigint")
    nodes = edges
    edges, seen = edges.where("a <> b"), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        step = save(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "star")
        state = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if edges is not nodes:
            drop(edges)
        edges = step
        if state == seen:
            break
        seen = state
    every = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return every.join(edges.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
