"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find grouping.

Each document is its set of word 3-grams (a document of one or two words: that one gram).  SuperMinHash gives
element e the values r(e, j) + j at the places of a random permutation, j = 0, 1, ...; a place keeps its least value.
Since round j only makes values of at least j, a document stops once all its places hold less, so long documents need
one to three rounds and short ones a bounded number of operations.  A signature has 256 places of 16 bits.

Equal signatures (by 128-bit hash) collapse to their least doc_id first, so a thousand exact copies cost one row each.  Signatures are cut
into bands; every band value that two documents share becomes a candidate bucket, buckets with the same members count
once, and within a bucket all pairs that are not yet in one component are compared on the whole signatures: no cap on
partners.  Verified pairs are joined by union-find across buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import save
from ._components import components, label
from ._text import U, Spans, mix, words

PLACES, SHINGLE, THRESHOLD = 256, 3, 0.45


def superminhash(items: np.ndarray, doc: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """(n, places) signatures; ``doc`` (ascending) says whose each item is.  Documents without items keep the maximum."""
    top = np.iinfo(np.uint64).max
    sig = np.full(n * places, top, np.uint64)
    perm: np.ndarray | None = None
    for j in range(places):
        if not len(items):
            break
        x = mix(items + U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = (j + (((mix(x) >> U(32)) * U(places - j)) >> U(32))).astype(np.int64)
        if perm is None:
            at = k
        else:
            row = np.arange(len(items))
            at = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(sig, doc * places + at, (U(j) << U(56)) | (x >> U(8)))
        most = sig.reshape(n, places).max(axis=1)
        stay = ((most == top) | ((most >> U(56)) > U(j)))[doc]
        items, doc = items[stay], doc[stay]
        if perm is None:
            if len(items):
                perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(items), 1))
                perm[np.arange(len(items)), k[stay]] = 0
        else:
            perm = perm[stay]
    return sig.reshape(n, places)


def _grams(w) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a piece of documents and whose they are."""
    n = np.diff(w.first)
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    begin = np.concatenate([[0], np.cumsum(many)])[:-1]
    start = np.repeat(w.first[:-1] - begin, many) + np.arange(len(doc))
    end = np.minimum(start + SHINGLE, w.first[1:][doc])
    return Spans(w.hash).of(start, end), doc


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0)
        for w in words(b.column(1), limit=1 << 20):
            own = np.flatnonzero(np.diff(w.first) > 0)
            sig = superminhash(*_grams(w), w.hi - w.lo)[own]
            small = (mix(sig) >> U(48)).astype(np.uint16)
            wide, place = np.ascontiguousarray(small).view(np.uint64), np.arange(1, small.shape[1] // 4 + 1, dtype=np.uint64)
            seals = [mix(mix(wide + mix(place + U(k))).sum(1)).view(np.int64) for k in (0, 1000)]
            yield pa.RecordBatch.from_arrays([ids.slice(w.lo, w.hi - w.lo).take(pa.array(own)), *map(pa.array, seals), pa.array([x.tobytes() for x in small], pa.binary())], ["doc_id", "h1", "h2", "sig"])


def rows_of_a_band(threshold: float, least: float = 0.9) -> int:
    """The most rows a band can have (1, 2, 4 or 8) for two documents at the threshold to share a band with a probability of
    ``least`` or more."""
    return max((r for r in (1, 2, 4, 8) if 1 - (1 - threshold**r) ** (PLACES // r) >= least), default=1)


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(ids), -1, rows).astype(np.uint64)
                key = np.zeros(sig.shape[:2], np.uint64)
                for k in range(0, rows, 4):  # four places fit a word
                    part = sig[:, :, k : k + 4]
                    word = (part << (np.arange(part.shape[2], dtype=np.uint64) * U(16))).sum(2, dtype=np.uint64)
                    key = mix(word + key) if k else word
                key = mix(key + mix(np.arange(key.shape[1], dtype=np.uint64) + U(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, key.shape[1]))], ["band", "doc_id"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each band value of two documents or more; once for the same members."""
    key, ids = [], []
    for b in batches:
        key.append(b.column(0).to_numpy())
        ids.append(b.column(1).to_numpy())
    if not key:
        return
    key, ids = np.concatenate(key), np.concatenate(ids)
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    with np.errstate(over="ignore"):
        seal = np.add.reduceat(mix(ids.view(np.uint64) + U(77)), edge).view(np.int64) if len(edge) else edge
    keep = np.flatnonzero(size > 1)
    if len(keep):
        _, one = np.unique(np.stack([seal[keep], size[keep]], 1), axis=0, return_index=True)
        keep = keep[np.sort(one)]
        off = np.concatenate([[0], np.cumsum(size[keep])])
        pick = np.repeat(edge[keep] - off[:-1], size[keep]) + np.arange(off[-1])
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids[pick]))
        yield pa.RecordBatch.from_arrays([pa.array(seal[keep]), pa.array(size[keep]), lists], ["seal", "size", "members"])


def link(sig: np.ndarray, least: float, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all rows of ``sig`` connected by pairs of estimated similarity ``least`` or more.
    Rows already in one component are not compared again; all others are, whatever their number."""
    n, m = sig.shape
    need = least * m
    a, b = [], []
    todo = np.arange(n)
    while len(todo) > 1:  # the first of the rest leads; all rows it doesn't take go on, and meet those it took
        near = np.flatnonzero((sig[todo[1:]] == sig[todo[0]]).sum(1) >= need) + 1
        a.append(np.full(len(near), todo[0]))
        b.append(todo[near])
        todo = np.delete(todo, np.append(near, 0))
    a, b = np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int)
    root = label(a, b, n)
    tips = np.unique(root)
    if len(tips) > 1 and len(tips) < n:  # taken rows may still be near a row of another component
        step = max(1, block // (n * m) + 1)
        c, d = [], []
        taken = np.setdiff1d(np.arange(n), tips)
        for lo in range(0, len(taken), step):
            t = taken[lo : lo + step]
            x, y = np.nonzero((sig[t][:, None, :] == sig[None, :, :]).sum(2) >= need)
            go = root[t[x]] != root[y]
            c.append(t[x][go])
            d.append(y[go])
        a, b = np.concatenate([a, *c]), np.concatenate([b, *d])
    return a, b


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        bucket, ids = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (0, 1))
        sig = np.frombuffer(b"".join(x for b in parts for x in b.column(2).to_pylist()), np.uint16).reshape(len(ids), -1)
        order = np.lexsort((ids, bucket))
        bucket, ids, sig = bucket[order], ids[order], sig[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(ids))
        left, right = [], []
        for lo, hi in zip(edge[:-1], edge[1:]):
            a, b = link(sig[lo:hi], least)
            left.append(ids[lo + a])
            right.append(ids[lo + b])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return run


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", one_task_edges: int = 4_000_000) -> DataFrame:
    """(doc_id, group_id, keep): one row for each distinct doc_id; group_id is the least doc_id of its group of near
    copies (itself if it has none) and keep is 1 for that one document.

    Defined cases: a null or word-less text is a group of its own; rows with a null id (or one that is no integer) can't be named and give no row;
    rows that share an id are one document, grouped by any of its texts; other columns are ignored whatever their
    names; an empty table gives no rows.  Bands are as long as the threshold allows.  Similarity is estimated on 256 places (standard error 0.031 at most)."""
    src = docs.select(F.col(f"`{id_col}`").try_cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    sig = save(src.mapInArrow(_sign, "doc_id bigint, h1 bigint, h2 bigint, sig binary"), "sig")
    same = save(sig.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "same")
    copies = sig.select("doc_id", "h1", "h2").join(same.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select("rep", "doc_id")
    bands = same.select("rep", "sig").mapInArrow(_bands(rows_of_a_band(threshold)), "band bigint, doc_id bigint").repartition("band")
    buckets = bands.mapInArrow(_buckets, "seal bigint, size bigint, members array<bigint>").dropDuplicates(["seal", "size"])
    pairs = buckets.select(F.xxhash64("seal", "size").alias("bucket"), F.explode("members").alias("rep"))
    close = pairs.join(same.select("rep", "sig"), "rep").select("bucket", "rep", "sig").repartition("bucket").mapInArrow(_verify(threshold), "a bigint, b bigint")
    group = components(close.union(copies), one_task_edges)
    every = src.select("doc_id").distinct()
    return every.join(group, every.doc_id == group.node, "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), (F.coalesce("root", "doc_id") == F.col("doc_id")).cast("int").alias("keep"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
