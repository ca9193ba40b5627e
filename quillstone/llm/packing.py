"""Packing: concatenate all documents and cut the tokens into fixed windows.

The order is that of md5("id:text"), in which neighbours have nothing in common; so ranges of the hash hold equal shares of
the bytes whatever the ids are, no id or source makes one of them long, and nothing about their bounds needs to be learnt.
Pass 1 counts the tokens of every range of about ``range_mb`` of text; the prefix sums of these totals are the ranges' global
offsets.  Pass 2 brings each range together in order and cuts it: windows that lie within a range are whole; the two at its
ends leave boundary records, which alone meet again by window.  There are at most MOST ranges (longer ones for a corpus of
terabytes), so the driver holds that many numbers at most.  Tokens are words (runs of anything but ASCII white space) or, with
a vocabulary's path, the ids of byte-pair encoding; each document ends with a separator token."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import save
from ._text import words

WINDOW, RANGE_MB, MOST, END = 2048, 32, 100_000, "<|endoftext|>"


@cache
def _encoder(vocabulary: str, pattern: str):
    """Byte-pair encoding by a file of base64 tokens and ranks; read once by each worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f) if t}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokeniser(vocabulary: str | None, pattern: str | None) -> Callable[[str], list[bytes]]:
    """Words, or ids in decimal where a vocabulary is given."""
    if vocabulary is None:
        return lambda t: t.encode("utf-8").split()
    return lambda t: [b"%d" % i for i in _encoder(vocabulary, pattern).encode_ordinary(t)]


def _counter(vocabulary: str | None, pattern: str | None):
    def count(texts: pa.Array) -> np.ndarray:
        if vocabulary is not None:
            return np.array([len(_encoder(vocabulary, pattern).encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in texts)], np.int64)
        n = [np.diff(w.first) for w in words(texts, hashed=False)]
        return np.concatenate(n) if n else np.zeros(0, np.int64)

    return count


def _totals(vocabulary: str | None, pattern: str | None, ends: int):
    """Tokens by range, one row a range and batch."""
    count = _counter(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, of = np.unique(b.column(0).to_numpy(), return_inverse=True)
            n = np.zeros(len(parts), np.int64)
            np.add.at(n, of, count(b.column(1)) + ends)
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(n)], ["part", "n"])

    return run


class _Cut:
    """Cuts one range's tokens; ``at`` is the global place of its first token."""

    def __init__(self, at: int, window: int):
        self.begin = self.at = at
        self.window = window
        self.tokens: list[bytes] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []

    def add(self, doc: int | None, tokens: list[bytes]):
        done = 0
        while done < len(tokens):
            room = self.window - self.at % self.window
            part = tokens[done : done + room]
            self.docs.append(doc)
            self.starts.append(self.at % self.window)
            self.tokens += part
            self.at += len(part)
            done += len(part)
            if self.at % self.window == 0:
                yield self.flush()

    def flush(self) -> tuple:
        first = self.at - len(self.tokens)
        row = (first // self.window, first % self.window, len(self.tokens), b" ".join(self.tokens).decode("utf-8"), self.docs, self.starts)
        self.tokens, self.docs, self.starts = [], [], []
        return row


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SCHEMA = "window_id bigint, begin bigint, n_tokens bigint, text string, docs array<bigint>, starts array<bigint>"


def _cutter(offsets: np.ndarray, window: int, end: str, vocabulary: str | None, pattern: str | None):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    last = [end.encode()] if end else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, now, rows, size = None, None, [], 0
        split = tokeniser(vocabulary, pattern)
        for b in batches:
            part, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            text = b.column(2)
            for k, (p, doc) in enumerate(zip(part, ids)):
                if p != now:
                    if cut and cut.tokens:
                        rows.append(cut.flush())
                    cut, now = _Cut(int(offsets[p]), window), p
                t = text[k].as_py()
                tokens = (split(t) if t else []) + last
                for row in cut.add(doc, tokens):
                    rows.append(row)
                    size += len(row[3])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)
                    rows, size = [], 0
        if cut and cut.tokens:
            rows.append(cut.flush())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    return run


def _place(doc_id, text, nth=None):
    """Key of the order."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")), *([] if nth is None else [nth.cast("string")])]
    return F.md5(F.concat_ws(":", *parts))


def pack(docs: DataFrame, window: int = WINDOW, end: str = END, range_mb: float = RANGE_MB, vocabulary: str | None = None, pattern: str | None = None, copies_apart: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(window_id, n_tokens, text, doc_ids, starts): the windows in order, each with its tokens joined by spaces, the
    documents it holds and where each begins in it (both joined by commas).  All windows but the last are full.

    ``vocabulary`` is the path of a byte-pair vocabulary that every worker can read, and ``pattern`` its splitting pattern;
    tokens are then ids, and ``end`` should be the separator's id.  With ``copies_apart`` equal rows are numbered from 0 and
    the order is that of md5("id:text:number"), so the copies of a document don't stand side by side.

    Defined cases: a null, empty or word-less text is its separator alone (nothing if ``end`` is ""); repeated rows are packed
    as often as they appear; a null id (or one that is no integer) shows as "null"; other columns are ignored; an empty table
    gives no rows."""
    src = docs.select(F.col(f"`{id_col}`").try_cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST, max(1, -(-int(size) // int(range_mb * (1 << 20)))))
    nth = None
    if copies_apart:
        src = src.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))) - 1)
        nth = F.col("nth")
    keyed = src.select(_place(F.col("doc_id"), F.col("text"), nth).alias("key"), "doc_id", "text")
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)).cast("int").alias("part")
    totals = np.zeros(ranges, np.int64)
    for p, n in keyed.select(part, "text").mapInArrow(_totals(vocabulary, pattern, 1 if end else 0), "part int, n bigint").groupBy("part").agg(F.sum("n")).collect():  # MOST rows at most
        totals[p] = n
    offsets = np.concatenate([[0], np.cumsum(totals)])
    cut = keyed.select(part, "doc_id", "text", "key").repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key").mapInArrow(_cutter(offsets, window, end, vocabulary, pattern), _SCHEMA)
    cut = save(cut, "windows")
    whole = F.col("n_tokens") == window
    bits = F.array_sort(F.collect_list(F.struct("begin", "n_tokens", "text", "docs", "starts")))
    ends = cut.where(~whole).groupBy("window_id").agg(bits.alias("bits")).select("window_id", F.aggregate("bits", F.lit(0).cast("bigint"), lambda s, x: s + x.n_tokens).alias("n_tokens"), F.array_join(F.transform("bits", lambda x: x.text), " ").alias("text"), F.flatten(F.transform("bits", lambda x: x.docs)).alias("docs"), F.flatten(F.transform("bits", lambda x: x.starts)).alias("starts"))
    every = cut.where(whole).select(*ends.columns).unionByName(ends)
    return every.select("window_id", "n_tokens", "text", F.array_join("docs", ",", "null").alias("doc_ids"), F.array_join("starts", ",").alias("starts"))


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
with w as (select doc_id, md5(concat_ws(':', coalesce(doc_id::varchar, 'null'), coalesce(text, ''))) as key, list_append(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), '{END}') as toks from documents),
     o as (select doc_id, toks, (sum(len(toks)) over (order by key, doc_id) - len(toks))::bigint as off from w),
     t as (select doc_id, unnest(toks) as tok, off + generate_subscripts(toks, 1) - 1 as pos from o),
     g as (select pos // {WINDOW} as window_id, doc_id, min(pos) as pos0, count(*) as n, string_agg(tok, ' ' order by pos) as text from t group by 1, 2)
select window_id::bigint as window_id, sum(n)::bigint as n_tokens, string_agg(text, ' ' order by pos0) as text,
       string_agg(doc_id::varchar, ',' order by pos0) as doc_ids, string_agg((pos0 % {WINDOW})::varchar, ',' order by pos0) as starts
from g group by window_id
"""
