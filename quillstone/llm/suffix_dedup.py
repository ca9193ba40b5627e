"""Suffix-array dedup: passages of at least ``least`` words that occur in two documents or more.

A corpus has no place for one suffix array, so shards are chosen by content.  Every document is winnowed: of any
``least`` words in a row, one n-gram of ``GRAM`` words (an anchor) is chosen by its hash alone, so all copies of a passage
share an anchor at the same place.  Anchors meet by hash; the windows around equal anchors (all that a passage through
the anchor can reach to have ``least`` words) are compared:

* windows equal as a whole need no sorting: they repeat throughout;
* the others go, as 32-bit words, to the shard of their anchor, whose suffix array is built by induced sorting:
  suffixes are classed as smaller or larger than the next, the leftmost-smaller substrings are named and sorted
  recursively, and two scans over the buckets induce the order of all others from theirs, in linear time; permuted common
  prefixes are then computed at irreducible places and carried on by one less elsewhere;
* an anchor that more than ``hot`` windows of one map task have (boilerplate) is split by the words around it: each of its
  windows gives the hashes of its ``least`` words from every place on, which meet one by one with combined counts, so neither
  an anchor nor a passage of a third of the corpus comes together in one task.

The union over anchors is exact: it is the same as comparing every ``least`` consecutive words of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import save
from ._text import Spans, winnow, words

LEAST, GRAM, SHARD, HOT = 50, 16, 1 << 17, 256


def _rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    step = np.zeros(len(keys), np.int64)
    step[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def _induce(s: list[int], pred: list[int], small: list[bool], heads: list[int], tails: list[int], seeds: list[int]) -> list[int]:
    """Places of all suffixes in order, induced from leftmost-smaller ones in the order given: these go to the ends of their
    symbols' buckets; one scan upwards puts the larger suffixes at the heads of theirs, one downwards the smaller ones at the
    ends.  ``pred`` has the place before each (-1 for the first).  Linear: every suffix is looked at once in either scan."""
    n = len(s)
    sa, end = [-1] * n, tails[:]
    for i in reversed(seeds):
        c = s[i]
        end[c] -= 1
        sa[end[c]] = i
    head = heads[:]
    last = n - 1  # the end of the text counts as the least suffix: the one before it comes first in its bucket
    if not small[last]:
        sa[head[s[last]]] = last
        head[s[last]] += 1
    for i in sa:
        j = pred[i] if i >= 0 else -1
        if j >= 0 and not small[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    end = tails[:]
    for k in range(n - 1, -1, -1):
        i = sa[k]
        j = pred[i] if i >= 0 else -1
        if j >= 0 and small[j]:
            c = s[j]
            end[c] -= 1
            sa[end[c]] = j
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers by induced sorting; the end counts as less than any symbol."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = _rank(s)
    # classes: smaller (S) or larger (L) than the next suffix; the last is larger, as only the end follows it
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(s[1:] - s[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(s)
    tails = np.cumsum(count)
    heads = tails - count
    given = s.tolist(), list(range(-1, n - 1)), small.tolist(), heads.tolist(), tails.tolist()
    if not len(lms):
        return np.array(_induce(*given, []), np.int64)
    first = np.array(_induce(*given, lms.tolist()), np.int64)
    # leftmost-smaller substrings are now in order; equal neighbours get one name
    which = np.full(n, -1, np.int64)
    which[lms] = np.arange(len(lms))
    order = which[first]
    order = order[order >= 0]
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # the last one runs into the end, which no other has
    a, b = order[:-1], order[1:]
    same = (size[a] == size[b]) & (a != len(lms) - 1) & (b != len(lms) - 1)
    rows = np.flatnonzero(same)
    m = size[a[rows]]
    off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    x, y = np.repeat(lms[a[rows]], m) + off, np.repeat(lms[b[rows]], m) + off
    differ = (s[x] != s[y]) | (small[x] != small[y])
    if len(rows):
        same[rows] = ~np.logical_or.reduceat(differ, np.cumsum(m) - m)
    name = np.empty(len(lms), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    if name.max() + 1 < len(lms):
        order = suffix_array(name)
    return np.array(_induce(*given, lms[order].tolist()), np.int64)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[k] of suffixes sa[k-1] and sa[k] (lcp[0] is 0), by permuted common prefixes."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    j = before
    # irreducible: the preceding symbols differ, so nothing is known from the place before
    known = (i > 0) & (j > 0)
    known[known] = s[i[known] - 1] == s[j[known] - 1]
    known &= np.concatenate([[False], before[:-1] >= 0])
    plcp = np.zeros(n, np.int64)
    act = np.flatnonzero(~known & (j >= 0))
    k = 0
    while len(act):
        a, b = act + k, j[act] + k
        ok = (a < n) & (b < n)
        ok[ok] = s[a[ok]] == s[b[ok]]
        act = act[ok]
        plcp[act] += 1
        k += 1
    source = np.maximum.accumulate(np.where(known, 0, i))
    plcp = np.where(known, np.maximum(plcp[source] - (i - source), 0), plcp)
    return plcp[sa]


def _other(lcp: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """By place in the suffix array: longest common prefix with any suffix of another owner.  ``lcp`` is 0 where no suffix
    comes before, so the first run's values are 0 as they should be."""
    best = np.zeros(len(lcp), np.int64)
    for back in (False, True):
        own, low = (owner[::-1], np.concatenate([[0], lcp[:0:-1]])) if back else (owner, lcp)
        got = low.copy()  # with the neighbour before; where that has the same owner, what it shares with an earlier one
        same = np.concatenate([[False], own[1:] == own[:-1]])
        run = np.flatnonzero(same)
        depth = run - np.maximum.accumulate(np.where(same, 0, np.arange(len(own))))[run]
        for d in range(1, int(depth.max(initial=0)) + 1):
            at = run[depth == d] if d < 64 else None
            if at is None:  # long runs of one owner: one by one
                for x in run[depth >= d]:
                    got[x] = min(low[x], got[x - 1])
                break
            got[at] = np.minimum(low[at], got[at - 1])
        best = np.maximum(best, got[::-1] if back else got)
    return best


def _anchors(least: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "anchor", "doc_id", "lo", "hi", "whole", "split"]
        for b in batches:
            ids, have = b.column(0).to_numpy(), []
            for w in words(b.column(1)):
                spans = Spans(w.hash)
                g = spans.grams(GRAM)
                at = winnow(g, w.first, GRAM, least - GRAM + 1)
                doc = np.searchsorted(w.first, at, "right") - 1
                lo, hi = np.maximum(at - (least - GRAM), w.first[doc]), np.minimum(at + least, w.first[doc + 1])
                off = w.first[doc]
                have.append((g[at].view(np.int64), ids[w.lo + doc], lo - off, hi - off, spans.of(lo, hi).view(np.int64)))
            if not have:
                continue
            anchor, doc, lo, hi, whole = (np.concatenate(c) for c in zip(*have))
            _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
            split = count[of] > hot
            part = np.where(split, doc, anchor)  # windows that are split needn't meet as such
            told = np.unique(anchor[split])  # but those of other tasks are to be split too
            none = np.zeros(len(told), np.int64)
            cols = [np.concatenate(c) for c in ((part, told), (anchor, told), (doc, none), (lo, none), (hi, none), (whole, none), (split, np.ones(len(told), bool)))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, bool))], names)

    return run


_MET = "anchor bigint, doc_id bigint, lo int, hi int, many boolean, kind tinyint"
FOUND, ASK, SPLIT = 0, 1, 2


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def _meet(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        anchor, doc, lo, hi, whole = (t.column(k).to_numpy() for k in range(1, 6))
        split = t.column(6).to_numpy()
        names = [x.split()[0] for x in _MET.split(", ")]
        if split.any():
            told = np.unique(anchor[split & (hi == 0)])
            split |= np.isin(anchor, told)
            pick = split & (hi - lo >= least)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[pick]) for c in (anchor, doc, lo, hi)], pa.array(np.zeros(pick.sum(), bool)), pa.array(np.full(pick.sum(), SPLIT, np.int8))], names)
            anchor, doc, lo, hi, whole = (c[~split] for c in (anchor, doc, lo, hi, whole))
        # most anchors occur once
        order = np.argsort(anchor, kind="stable")
        x = anchor[order]
        twin = np.zeros(len(x), bool)
        twin[1:] = x[1:] == x[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        if not len(order):
            return
        order = order[np.lexsort((lo[order], doc[order], whole[order], anchor[order]))]
        anchor, doc, lo, hi, whole = (c[order] for c in (anchor, doc, lo, hi, whole))
        new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_w = new_a | np.concatenate([[True], whole[1:] != whole[:-1]])
        group, part = np.cumsum(new_a) - 1, np.cumsum(new_w) - 1
        first = np.flatnonzero(new_w)
        many = np.zeros(len(first), bool)  # windows found in several documents
        np.logical_or.at(many, part, doc != doc[first][part])
        kinds = np.bincount(group[first])[group]  # different windows of the anchor
        found = many[part] & (hi - lo >= least)
        # an anchor of several windows: each window of one document is to be searched; one of each other kind is searched against
        ask = (kinds > 1) & (~many[part] | new_w)
        low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group, doc)
        np.maximum.at(high, group, doc)
        ask &= (low < high)[group]
        for pick, flag in ((found, FOUND), (ask, ASK)):
            if pick.any():
                cols = [anchor[pick], doc[pick], lo[pick], hi[pick], many[part][pick], np.full(int(pick.sum()), flag, np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id by row, words, document, anchor, first and last word, many) of the windows asked of each piece of texts."""
    for b in batches:
        ids, asks = b.column(0).to_numpy(), b.column(2)
        sizes = np.diff(asks.offsets.to_numpy())
        flat = asks.flatten()
        anchor, lo, hi, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        for w in words(b.column(1)):
            rows = slice(begin[w.lo], begin[w.hi])
            if rows.start == rows.stop:
                continue
            doc = np.repeat(np.arange(w.hi - w.lo), sizes[w.lo : w.hi])
            ok = hi[rows] + w.first[doc] <= w.first[doc + 1]  # rows of one doc_id may have texts of their own
            yield ids[w.lo + doc[ok]], w, doc[ok], anchor[rows][ok], lo[rows][ok], hi[rows][ok], many[rows][ok]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, w, doc, anchor, lo, hi, many in _texts(batches):
        word = (w.hash >> np.uint64(32)).astype(np.uint32)
        size = hi - lo
        off = np.concatenate([[0], np.cumsum(size)])
        flatw = word[np.repeat(lo + w.first[doc] - off[:-1], size) + np.arange(off[-1])]
        text = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(flatw)])
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.array(lo), pa.array(many), text], ["anchor", "doc_id", "lo", "many", "words"])


def _grams(least: int):
    """Hash of the ``least`` words from every place of the windows on, with the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w, doc, _, lo, hi, _ in _texts(batches):
            spans = Spans(w.hash)
            n = hi - lo - least + 1
            row = np.repeat(np.arange(len(n)), n)
            at = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = at + w.first[doc[row]]
            key = spans.of(start, start + least)
            _, one = np.unique(np.stack([doc[row], at]), axis=1, return_index=True)  # windows overlap
            yield pa.RecordBatch.from_arrays([pa.array(key[one].view(np.int64)), pa.array(ids[row[one]]), pa.array(at[one].astype(np.int32))], ["key", "doc_id", "lo"])

    return run


def _shards(least: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        anchor, doc, lo, many = (t.column(k).to_numpy() for k in range(4))
        text = t.column(4).combine_chunks()
        order = np.lexsort((doc, anchor))
        size = np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1])[order] // 4
        edge = np.append(np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]])), len(order))
        total = np.concatenate([[0], np.cumsum(size + 1)])
        k = 0
        while k < len(edge) - 1:  # whole anchors, up to a shard's size
            stop = max(k + 1, int(np.searchsorted(total[edge], total[edge[k]] + shard, "right")) - 1)
            rows = order[edge[k] : edge[stop]]
            yield _search(anchor[rows], doc[rows], lo[rows], many[rows], text.take(pa.array(rows)), least)
            k = stop

    return run


def _search(anchor, doc, lo, many, text, least) -> pa.RecordBatch:
    off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] // 4
    flat = np.frombuffer(text.buffers()[2], np.uint32)[off[0] : off[-1]].astype(np.uint64)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    group = np.cumsum(np.concatenate([[0], (anchor[1:] != anchor[:-1]).astype(np.int64)]))
    # a symbol is a word in its anchor's group; a separator of its own ends each window
    symbol = _rank((group[row].astype(np.uint64) << np.uint64(32)) | flat) + 1
    at = np.arange(len(row)) + row
    s = np.empty(len(row) + len(size), np.int64)
    s[at] = symbol + len(size)
    seps = np.cumsum(size) + np.arange(len(size))
    s[seps] = np.arange(1, len(size) + 1)
    holder = np.empty(len(s), np.int64)
    holder[at], holder[seps] = row, np.arange(len(size))
    place = np.empty(len(s), np.int64)
    place[at] = np.arange(len(row)) - (off[:-1] - off[0])[row]
    place[seps] = 0
    owner = np.unique(np.stack([doc, np.where(many, np.arange(1, len(doc) + 1), 0)], 1), axis=0, return_inverse=True)[1].ravel()
    sa = suffix_array(s)
    match = np.empty(len(s), np.int64)
    match[sa] = _other(common_prefixes(s, sa), owner[holder[sa]])
    match[seps] = 0
    goes = np.where(match >= least, np.arange(len(s)) + match, 0)
    fresh = goes > np.concatenate([[0], goes[:-1]])
    pick = np.flatnonzero((match >= least) & fresh & ~many[holder])
    h = holder[pick]
    start = lo[h] + place[pick]
    return pa.RecordBatch.from_arrays([pa.array(doc[h]), pa.array(start.astype(np.int32)), pa.array((start + match[pick]).astype(np.int32))], ["doc_id", "lo", "hi"])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge ranges that overlap or touch."""
    t = _table(batches)
    if t is None:
        return
    doc, lo, hi = (t.column(k).to_numpy() for k in range(3))
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    shift = (np.cumsum(new_doc) - 1) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.concatenate([[True], (lo + shift)[1:] > reach[:-1]])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(doc)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(doc[begin]), pa.array(lo[begin]), pa.array((reach - shift)[last])], ["doc_id", "start_word", "end_word"])


def repeats(docs: DataFrame, least: int = LEAST, shard: int = SHARD, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word): the maximal ranges of each document (end exclusive, words counted from 0) every
    word of which lies in ``least`` words or more that another document has too.

    Defined cases: null, empty and short texts have no ranges; rows that share a doc_id are one document, whose own
    repeats don't count; rows with a null id (or one that is no integer) can't be named and are left out; other columns are ignored; an empty table
    gives no rows.  ``least`` must be over GRAM."""
    src = docs.select(F.col(f"`{id_col}`").try_cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    found = src.mapInArrow(_anchors(least, hot), "part bigint, anchor bigint, doc_id bigint, lo int, hi int, whole bigint, split boolean").repartition("part").mapInArrow(_meet(least), _MET)
    found = save(found, "met")

    def asked(kind: int) -> DataFrame:
        asks = found.where(F.col("kind") == kind).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "lo", "hi", "many")).alias("asks"))
        return src.join(asks.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "asks")

    wide = asked(ASK).mapInArrow(_windows, "anchor bigint, doc_id bigint, lo int, many boolean, words binary").repartition("anchor")
    ranges = found.where(F.col("kind") == FOUND).select("doc_id", "lo", "hi").union(wide.mapInArrow(_shards(least, shard), "doc_id bigint, lo int, hi int"))
    if found.where(F.col("kind") == SPLIT).limit(1).count():
        grams = save(asked(SPLIT).mapInArrow(_grams(least), "key bigint, doc_id bigint, lo int"), "grams")
        again = grams.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
        ranges = ranges.union(grams.join(again, "key").select("doc_id", "lo", (F.col("lo") + least).alias("hi")))
    return ranges.repartition("doc_id").mapInArrow(_union, "doc_id bigint, start_word bigint, end_word bigint")


def op1(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
with w as (select doc_id, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) as tok,
                  generate_subscripts(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), 1) - 1 as i from documents),
     g as (select doc_id, i, string_agg(tok, ' ') over f as gram, count(*) over f as n from w
           window f as (partition by doc_id order by i rows between current row and {LEAST - 1} following)),
     h as (select doc_id, i, gram from g where n = {LEAST}),
     r as (select distinct doc_id, i from h where gram in (select gram from h group by gram having count(distinct doc_id) > 1)),
     m as (select *, case when i - lag(i) over (partition by doc_id order by i) <= {LEAST} then 0 else 1 end as new from r),
     k as (select *, sum(new) over (partition by doc_id order by i) as island from m)
select doc_id, min(i)::bigint as start_word, (max(i) + {LEAST})::bigint as end_word from k group by doc_id, island
"""
