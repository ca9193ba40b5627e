"""Line dedup: two Bloom filters, then exact confirmation of the suspected repeats only.

Pass 1 sets each line's bits in a once-seen filter, and in a twice-seen filter where the once-seen one already had them
all.  Filters of parts merge by (o1|o2, t1|t2|(o1&o2)), which never loses a line seen in two parts.  Filters are cut
into segments by hash, so that parts meet in a shuffle segment by segment.  Pass 2 sends only lines that the twice-seen
filter holds to the shuffle, where 128-bit hashes confirm repeats exactly and choose the first occurrence by
(doc_id, line number).

The twice-seen filter is broadcast while it takes at most ``filter_mb``; its size follows the number of lines (one count
before).  Beyond that every line's hash goes to the exact shuffle, with the same result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import fresh, save
from ._text import BASE, BYTE, CHUNK, SPACE, U, _powers, mix, pieces, strings

BITS, HASHES, SEGMENT_BITS = 16, 4, 20  # bits a line, bits set by a line, bits of a segment (their logarithm)
SEGMENT = 1 << SEGMENT_BITS


@dataclass
class Lines:
    """Lines of documents lo..hi-1 of a batch that aren't blank: whose each is, its number there, its bytes and a hash."""

    lo: int
    hi: int
    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    hash: np.ndarray

    def digest(self, pick: np.ndarray) -> np.ndarray:
        """(n, 2) 128-bit hashes of some of the lines."""
        view = memoryview(self.data)
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(self.start[pick].tolist(), self.end[pick].tolist())), ">u8").reshape(-1, 2).astype(np.uint64)


def lines(texts: pa.Array) -> Iterator[Lines]:
    """Lines are what "\\n" separates; one of ASCII white space alone is blank.  A few hundred kilobytes at a time."""
    offsets, data = strings(texts)
    for lo, hi in pieces(offsets, CHUNK):
        own = data[int(offsets[lo]) : int(offsets[hi])]
        at = (offsets[lo : hi + 1] - offsets[lo]).astype(np.int64)
        cut = np.flatnonzero(own == 10)
        start, end = np.sort(np.concatenate([at[:-1], cut + 1])), np.sort(np.concatenate([cut, at[1:]]))
        count = np.diff(np.searchsorted(cut, at)) + 1
        row = np.repeat(np.arange(hi - lo), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        solid = np.concatenate([[0], np.cumsum(~SPACE[own])])
        keep = np.flatnonzero(solid[end] > solid[start])
        start, end = start[keep], end[keep]
        up, down = _powers(BASE, len(own) + 1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(BYTE[own] * up[: len(own)], out=total[1:])
        yield Lines(lo, hi, row[keep], number[keep], start, end, own, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash and its bits there."""
    seg = ((h >> U(32)) * U(segments)) >> U(32)
    low = mix(h ^ U(0x5851F42D4C957F2D))
    step = mix(low) | U(1)
    at = np.stack([(low + U(i) * step) >> U(64 - SEGMENT_BITS) for i in range(HASHES)], 1)
    return seg.astype(np.int64), at.astype(np.int64)


def _filters(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [x.hash for b in batches for x in lines(b.column(0))]
        h = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        del seen
        if not len(h):
            return
        one = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        again = np.diff(np.append(one, len(h))) > 1
        h = h[one]
        edge = np.searchsorted(h, [-(-(k << 64) // segments) for k in range(1, segments)]) if segments > 1 else []
        edge = np.concatenate([[0], edge, [len(h)]]).astype(np.int64)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            seg, at = _places(h[edge[k] : edge[k + 1]], segments)
            both = again[edge[k] : edge[k + 1]]
            for s in np.unique(seg).tolist():  # a rounding apart from k at most
                once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
                once[at[seg == s].ravel()] = True
                twice[at[(seg == s) & both].ravel()] = True
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([_press(once)], pa.binary()), pa.array([_press(twice)], pa.binary())], ["segment", "once", "twice"])

    return run


def _press(bits: np.ndarray) -> bytes:
    """A sparse filter travels as the gaps between its bits."""
    at = np.flatnonzero(bits)
    if len(at) * 4 < len(bits) // 8:
        return b"s" + at.astype(np.uint32).tobytes()
    return b"d" + np.packbits(bits).tobytes()


def _unpress(x: bytes) -> np.ndarray:
    if x[:1] == b"s":
        bits = np.zeros(SEGMENT, bool)
        bits[np.frombuffer(x, np.uint32, offset=1)] = True
        return bits
    return np.unpackbits(np.frombuffer(x, np.uint8, offset=1)).astype(bool)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the filters of parts, segment by segment (a partition holds whole segments)."""
    have: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for seg, o, t in zip(*(b.column(k).to_pylist() for k in range(3))):
            o, t = _unpress(o), _unpress(t)
            if seg in have:
                once, twice = have[seg]
                twice |= t | (once & o)
                once |= o
            else:
                have[seg] = [o, t]
    for seg, (_, twice) in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([seg]), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "twice"])


def _suspects(filters, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filters is None else filters.value
        for b in batches:
            for x in lines(b.column(1)):
                pick = np.arange(len(x.hash))
                if bits is not None and len(pick):
                    seg, at = _places(x.hash, segments)
                    held = np.ones(len(pick), bool)
                    for i in range(HASHES):
                        p = at[:, i]
                        held &= (bits[seg, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
                    pick = np.flatnonzero(held)
                h = x.digest(pick)
                who = b.column(0).slice(x.lo, x.hi - x.lo).take(pa.array(x.row[pick]))
                yield pa.RecordBatch.from_arrays([who, pa.array(x.number[pick].astype(np.int32)), pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64))], ["who", "line", "h1", "h2"])

    return run


def _breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, data = strings(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows + int(np.count_nonzero(data[int(offsets[0]) : int(offsets[-1])] == 10))])], ["n"])


def removals(docs: DataFrame, filter_mb: int = 256) -> DataFrame:
    """(doc_id, seal, lines): numbers of the lines that repeat an earlier one, for the documents that have such;
    seal is the hash of the whole text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    n = docs.select("text").mapInArrow(_breaks, "n bigint").agg(F.sum("n")).first()[0] or 0
    segments = max(1, -(-int(n) * BITS // SEGMENT))
    filters = None
    if segments * SEGMENT // 8 <= filter_mb << 20:
        merged = docs.select("text").mapInArrow(_filters(segments), "segment bigint, once binary, twice binary").repartition("segment").mapInArrow(_merge, "segment bigint, twice binary")
        bits = np.zeros((segments, SEGMENT // 8), np.uint8)
        for seg, twice in merged.toLocalIterator():
            bits[seg] = np.frombuffer(twice, np.uint8)
        filters = spark.sparkContext.broadcast(bits)
    who = F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.xxhash64("text").alias("seal"))
    found = docs.select(who.alias("who"), "text").mapInArrow(_suspects(filters, segments), "who struct<none boolean, doc_id bigint, seal bigint>, line int, h1 bigint, h2 bigint")
    # the first occurrence has the least place: no id last, then doc_id and line; equal places are one occurrence.
    # Minima combine before the shuffle, and a join that meets a hot line can be split, so no task sees all of one line.
    found, place = save(found, "suspects"), F.struct("who", "line")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = found.join(first, ["h1", "h2"]).where(place > F.col("first"))
    return again.groupBy("who").agg(F.collect_set("line").alias("lines")).select("who.doc_id", "who.seal", "lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_mb: int = 256, counts: bool = True) -> DataFrame:
    """``docs`` with the lines that repeat an earlier line (by doc_id, then line number) removed from the text; with
    ``counts`` also lines_in and lines_out, which replace input columns of these names.

    Lines are what "\\n" separates, compared whole.  Blank lines are never repeats and stay.  Defined cases: a null text
    stays null (0 lines); an empty text is one blank line; a null doc_id (or one that is no integer) comes after all others; rows equal in doc_id
    and text are one document, which may appear in several rows; rows of one doc_id with other texts are other
    documents, in an order of their own; all other columns pass through unchanged; an empty table gives no rows."""
    if counts:
        docs = docs.drop(*[c for c in docs.columns if c.lower() in ("lines_in", "lines_out")])
    key, seal, lines, parts, kept, out = fresh(docs, "key", "seal", "lines", "parts", "kept", "out")
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").try_cast("bigint")
    base = docs.select(ident.alias("doc_id"), text.cast("string").alias("text"))
    gone = removals(base, filter_mb).toDF(key, seal, lines)
    held = docs.join(gone.hint("shuffle_hash"), ident.eqNullSafe(F.col(key)) & (F.xxhash64(text.cast("string")) == F.col(seal)), "left")
    held = held.withColumn(parts, F.split(text, "\n"))
    held = held.withColumn(kept, F.when(F.col(lines).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines))))
    new = F.when(F.col(kept).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(parts), i)), "\n"))
    n_in = F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("bigint")
    more = [n_in.alias("lines_in"), F.coalesce(F.size(kept).cast("bigint"), n_in).alias("lines_out")] if counts else []
    # exploding an array of one keeps later filters and columns from computing the text again
    held = held.select(F.explode(F.array(new)).alias(out), *[F.col(f"`{c}`") for c in docs.columns if c != text_col], *more)
    return held.select(*[F.col(out).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *[m for m in ("lines_in", "lines_out") if counts])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"))


SQL = """
with l as (select doc_id, i, line, trim(line, E' \\t\\n\\r\\f\\v') <> '' as solid from
           (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
     f as (select *, row_number() over (partition by line order by doc_id, i) as k from l)
select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where k = 1 or not solid), '') as text,
       count(*)::bigint as lines_in, count(*) filter (where k = 1 or not solid)::bigint as lines_out
from f group by doc_id
"""
