"""Embedding near-dedup: a forest of random-projection trees with spill.

Each tree splits the vectors by their projection on a random direction, at the quantiles around the median: those in
between go to both sides (spill), so close vectors seldom part, and several trees make up for those that do.  The upper
levels, whose thresholds come from a sample, route vectors to tasks; each task goes on splitting its share exactly down to
leaves.  All pairs of a leaf are compared, those of at least the threshold's cosine are joined, and union-find merges the
leaves of all trees.  Leaves that can't be split (copies) are compared whole, whatever their size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import save
from ._components import components, label

THRESHOLD, TREES, LEAF, SPILL, SHARE, SAMPLE_MB, SEED = 0.9, 8, 256, 0.25, 40_000, 64, 29


def _plane(seed: int, tree: int, path: int, dim: int) -> np.ndarray:
    return np.random.default_rng((seed, tree, path)).standard_normal(dim).astype(np.float32)


def _cut(x: np.ndarray, plane: np.ndarray, spill: float) -> tuple[float, float]:
    low, high = np.quantile(x @ plane, [0.5 - spill / 2, 0.5 + spill / 2], method="nearest")
    return float(low), float(high)


def leaves(x: np.ndarray, seed: int, tree: int, path: int, leaf: int, spill: float) -> Iterator[np.ndarray]:
    """Row numbers of the leaves of one tree from a node down."""
    todo = [(path, np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if len(rows) > leaf:
            plane = _plane(seed, tree, path, x.shape[1])
            proj = x[rows] @ plane
            low, high = np.quantile(proj, [0.5 - spill / 2, 0.5 + spill / 2], method="nearest")
            left, right = rows[proj <= high], rows[proj >= low]
            if len(left) < len(rows) and len(right) < len(rows):
                todo += [(2 * path, left), (2 * path + 1, right)]
                continue
            mid = (proj.min() + proj.max()) / 2  # ties at the quantiles: halve the range
            left, right = rows[proj <= mid], rows[proj > mid]
            if len(left) and len(right):
                todo += [(2 * path, left), (2 * path + 1, right)]
                continue
        yield rows


def close(x: np.ndarray, threshold: float, block: int = 1024) -> np.ndarray:
    """Least row of each row's component under cosine >= threshold (rows of unit length)."""
    n = len(x)
    root = np.arange(n)
    for lo in range(0, n, block):
        a, b = np.nonzero(x[lo : lo + block] @ x[lo:].T >= threshold)
        go = a < b
        a, b = a[go] + lo, b[go] + lo
        new = root[a] != root[b]
        if new.any():
            root = label(np.concatenate([root, a[new]]), np.concatenate([np.arange(n), b[new]]), n)
    return root


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _top(x: np.ndarray, trees: int, depth: int, seed: int, spill: float) -> list[dict[int, tuple[float, float]]]:
    """Thresholds of the upper ``depth`` levels by node, from a sample."""
    out = []
    for tree in range(trees):
        cuts, todo = {}, [(1, np.arange(len(x)))]
        while todo:
            path, rows = todo.pop()
            if path >> depth or len(rows) < 16:
                continue
            plane = _plane(seed, tree, path, x.shape[1])
            low, high = _cut(x[rows], plane, spill)
            proj = x[rows] @ plane
            cuts[path] = (low, high)
            todo += [(2 * path, rows[proj <= high]), (2 * path + 1, rows[proj >= low])]
        out.append(cuts)
    return out


def _route(tops: dict[int, list[dict[int, tuple[float, float]]]], trees: int, seed: int):
    """Vectors by length, tree and node; ``tops`` has the thresholds of the lengths that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            dims = every.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                b = every.take(pa.array(np.flatnonzero(dims == dim)))
                x = _unit(_matrix(b.column(1), dim))
                for tree, cuts in enumerate(tops.get(dim) or [{}] * trees):
                    todo = [(1, np.arange(len(x)))]
                    while todo:
                        path, rows = todo.pop()
                        if path in cuts:
                            low, high = cuts[path]
                            proj = x[rows] @ _plane(seed, tree, path, dim)
                            todo += [(2 * path, rows[proj <= high]), (2 * path + 1, rows[proj >= low])]
                        elif len(rows):
                            data = pa.array([v.tobytes() for v in x[rows]], pa.binary())
                            keys = [pa.array(np.full(len(rows), v, t)) for v, t in ((dim, np.int32), (tree, np.int32), (path, np.int64))]
                            yield pa.RecordBatch.from_arrays([*keys, b.column(0).take(pa.array(rows)), data], ["dim", "tree", "node", "id", "unit"])

    return run


def _compare(seed: int, leaf: int, spill: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        dim, tree, node, ids = (t.column(k).to_numpy() for k in range(4))
        unit = t.column(4)
        order = np.lexsort((ids, node, tree, dim))
        key = np.stack([dim, tree, node])[:, order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])), len(order))
        for lo, hi in zip(edge[:-1], edge[1:]):
            rows = order[lo:hi]
            x = np.frombuffer(b"".join(unit.take(pa.array(rows)).to_pylist()), np.float32).reshape(-1, int(dim[rows[0]]))
            for own in leaves(x, seed, int(tree[rows[0]]), int(node[rows[0]]), leaf, spill):
                own = np.sort(own)
                root = close(x[own], threshold)
                tied = np.flatnonzero(root != np.arange(len(own)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[own[tied]]]), pa.array(ids[rows[own[root[tied]]]])], ["a", "b"])

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, share: int = SHARE, sample_mb: int = SAMPLE_MB, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, group_id, keep): one row for each distinct id; group_id is the least id of its group of vectors joined by
    cosines of ``threshold`` or more (itself if it has none), and keep is 1 for that one.

    Defined cases: null, empty and zero vectors and those with null, infinite or NaN entries are groups of their own;
    vectors of each length are searched by themselves; equal vectors always share a group; rows that share an id are
    one item, grouped by any of its vectors; rows with a null id (or one that is no integer) give no row; other columns are ignored; an empty table
    gives no rows.  Upper levels part the vectors into shares of about ``share``; their thresholds come from a sample of
    ``sample_mb`` (by hash of the id) for each length, which leaves at least 64 vectors of it to a node: beyond 2,048 nodes for
    64 entries, shares grow instead."""
    ids = F.col(f"`{id_col}`").try_cast("bigint")
    src = vectors.select(ids.alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null")
    fine = src.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    keyed = fine.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(seed), "v").alias("h2"))
    same = save(keyed.groupBy("dim", "h1", "h2").agg(F.min("id").alias("rep"), F.first("v").alias("v")), "vectors")
    copies = keyed.select("id", "dim", "h1", "h2").join(same.select("dim", "h1", "h2", "rep"), ["dim", "h1", "h2"]).where("id <> rep").select("rep", "id")
    tops: dict[int, list[dict]] = {}
    for dim, n in same.groupBy("dim").count().collect():
        if (depth := max(0, int(np.ceil(np.log2(n / share))))) and (rows := min(n, (sample_mb << 20) // (8 * dim))) >= 128:
            sample = same.where(F.col("dim") == dim).select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(rows).toArrow()
            tops[dim] = _top(_unit(_matrix(sample.column("v").combine_chunks(), dim)), trees, min(depth, int(np.log2(rows / 64))), seed, spill)
    routed = same.select("rep", "v", "dim").mapInArrow(_route(tops, trees, seed), "dim int, tree int, node bigint, id bigint, unit binary").repartition("dim", "tree", "node")
    edges = routed.mapInArrow(_compare(seed, leaf, spill, threshold), "a bigint, b bigint")
    group = components(edges.union(copies))
    every = src.select("id").distinct()
    return every.join(group, every.id == group.node, "left").select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("group_id"), (F.coalesce("root", "id") == F.col("id")).cast("int").alias("keep"))


def op4(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
     p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
     reach as (select vec_id as a, vec_id as b from v union select r.a, p.b from reach r join p on r.b = p.a)
select a as vec_id, min(b) as group_id, (a = min(b))::int as keep from reach group by a
"""
