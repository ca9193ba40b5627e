"""Media columns: walk the boxes of ISO media containers and decode their sample tables, never their payloads.

One row a track: codec, duration and the byte ranges of its key frames, from the sample tables of the movie box and of
movie fragments.  Only box headers and tables are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NESTED = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"dinf", b"udta"))


class Broken(ValueError):
    """Not a well-formed container."""


def boxes(buf: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start of box, start of body, end) of the boxes in a range."""
    while begin < end:
        if end - begin < 8:
            raise Broken("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", buf, begin)
        body = begin + 8
        if size == 1:
            if end - begin < 16:
                raise Broken("a box header is cut off")
            (size,) = struct.unpack_from(">Q", buf, body)
            body += 8
        elif size == 0:
            size = end - begin
        if kind == b"uuid":
            body += 16
        if begin + size > end or body > begin + size:
            raise Broken(f"box {kind!r} overruns its parent")
        yield kind, begin, body, begin + size
        begin += size


def _tree(buf: bytes, begin: int, end: int) -> dict[bytes, list]:
    """Boxes of a range by type, nested to any depth."""
    root: dict[bytes, list] = {}
    todo = [(root, begin, end)]
    while todo:
        out, lo, hi = todo.pop()
        for kind, at, body, stop in boxes(buf, lo, hi):
            inner = {} if kind in NESTED else None
            out.setdefault(kind, []).append((at, body, stop, inner))
            if inner is not None:
                todo.append((inner, body, stop))
    return root


class Room:
    """How many samples a file can still have: each takes a byte or more, so a count in a damaged table asks for no more
    memory than the file's size explains."""

    def __init__(self, size: int):
        self.left = size

    def take(self, n: int) -> int:
        if n > self.left:
            raise Broken("more samples than bytes")
        self.left -= n
        return n


def _table(buf: bytes, at: tuple, kind: str, head: int = 8) -> np.ndarray:
    """The entries of a full box that counts them in the 4 bytes before ``head``."""
    _, body, stop, _ = at
    if stop - body < head:
        raise Broken("a table is cut off")
    (n,) = struct.unpack_from(">I", buf, body + head - 4)
    t = np.dtype(kind)
    if body + head + n * t.itemsize > stop:
        raise Broken("a table is cut off")
    return np.frombuffer(buf, t, n, body + head)


def _one(tree: dict, *path: bytes) -> tuple:
    for k, p in enumerate(path):
        if p not in tree:
            raise Broken(f"no {p.decode('latin1')} box")
        at = tree[p][0]
        tree = at[3] if k < len(path) - 1 else tree
    return at


def _sizes(buf: bytes, stbl: dict, room: Room | None = None) -> np.ndarray | None:
    """Sizes of the samples, from the size box or the compact one (fields of 4, 8 or 16 bits); None without either."""
    if b"stsz" in stbl:
        at = _one(stbl, b"stsz")
        (fixed, n) = struct.unpack_from(">II", buf, at[1] + 4)
        return np.full((room or Room(len(buf))).take(n), fixed, np.int64) if fixed else _table(buf, at, ">u4", 12).astype(np.int64)
    if b"stz2" not in stbl:
        return None
    _, body, stop, _ = _one(stbl, b"stz2")
    if stop - body < 12:
        raise Broken("a table is cut off")
    bits, n = struct.unpack_from(">7xBI", buf, body)
    if bits not in (4, 8, 16):
        raise Broken(f"sizes of {bits} bits")
    if body + 12 + -(-n * bits // 8) > stop:
        raise Broken("a table is cut off")
    if bits == 4:
        pair = np.frombuffer(buf, np.uint8, (n + 1) // 2, body + 12)
        return np.stack([pair >> 4, pair & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(buf, ">u2" if bits == 16 else np.uint8, n, body + 12).astype(np.int64)


def _samples(buf: bytes, stbl: dict, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offset, size, key) of each sample, and their total time."""
    stts = _table(buf, _one(stbl, b"stts"), ">u4,>u4") if b"stts" in stbl else np.zeros(0, ">u4,>u4")
    each = stts["f0"].astype(np.uint64) * stts["f1"].astype(np.uint64)
    time = (int((each >> np.uint64(32)).sum()) << 32) + int((each & np.uint64(0xFFFFFFFF)).sum())
    size = _sizes(buf, stbl, room)
    if size is None:
        if time or any(len(_table(buf, stbl[k][0], t)) for k, t in ((b"stco", ">u4"), (b"co64", ">u8")) if k in stbl):
            raise Broken("no stsz or stz2 box")
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), time
    n = len(size)
    chunks = _table(buf, _one(stbl, b"stco"), ">u4") if b"stco" in stbl else _table(buf, _one(stbl, b"co64"), ">u8")
    chunks = chunks.astype(np.int64)
    runs = _table(buf, _one(stbl, b"stsc"), ">u4,>u4,>u4")
    first = np.minimum(np.append(runs["f0"].astype(np.int64), len(chunks) + 1), len(chunks) + 1)
    if (np.diff(first) < 0).any():
        raise Broken("chunk runs out of order")
    per = np.repeat(runs["f1"].astype(np.int64), np.diff(first))[: len(chunks)]
    if per.sum() < n:
        raise Broken("fewer samples in chunks than sizes")
    start = np.minimum(np.concatenate([[0], np.cumsum(per)]), n)  # what chunks promise beyond the sizes isn't there
    chunk = np.repeat(np.arange(len(per)), np.diff(start))
    before = np.concatenate([[0], np.cumsum(size)])
    offset = chunks[chunk] + before[:-1] - before[start[chunk]]
    key = np.ones(n, bool)
    if b"stss" in stbl:
        key[:] = False
        sync = _table(buf, _one(stbl, b"stss"), ">u4").astype(np.int64)
        key[sync[(sync >= 1) & (sync <= n)] - 1] = True
    return offset, size, key, time


def _fragment(buf: bytes, moof: tuple, extends: dict[int, tuple], room: Room) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(track, offset, size, key, time) of the runs of one movie fragment."""
    for traf in moof[3].get(b"traf", []):
        tfhd = _one(traf[3], b"tfhd")[1]
        flags, track = struct.unpack_from(">II", buf, tfhd)
        flags &= 0xFFFFFF
        at, base = tfhd + 8, moof[0]
        if flags & 1:
            (base,) = struct.unpack_from(">Q", buf, at)
            at += 8
        at += 4 * bool(flags & 2)
        given = list(extends.get(track, (0, 0, 0)))
        for k, bit in enumerate((8, 16, 32)):
            if flags & bit:
                (given[k],) = struct.unpack_from(">I", buf, at)
                at += 4
        ahead = base
        for trun in traf[3].get(b"trun", []):
            tf, n = struct.unpack_from(">II", buf, trun[1])
            tf &= 0xFFFFFF
            at = trun[1] + 8
            if tf & 1:
                ahead = base + struct.unpack_from(">i", buf, at)[0]
                at += 4
            first = None
            if tf & 4:
                (first,) = struct.unpack_from(">I", buf, at)
                at += 4
            cols = [bit for bit in (0x100, 0x200, 0x400, 0x800) if tf & bit]
            room.take(n)
            if at + 4 * n * len(cols) > trun[2]:
                raise Broken("a run is cut off")
            rows = np.frombuffer(buf, ">u4", n * len(cols), at).reshape(n, len(cols)).astype(np.int64)
            pick = {c: rows[:, k] for k, c in enumerate(cols)}
            size = pick.get(0x200, np.full(n, given[1]))
            marks = pick.get(0x400, np.full(n, given[2])).copy()
            if first is not None and n:
                marks[0] = first
            offset = ahead + np.concatenate([[0], np.cumsum(size)])
            yield track, offset[:-1], size, (marks & 0x10000) == 0, int(pick[0x100].sum()) if 0x100 in pick else n * given[0]
            ahead = int(offset[-1])


def tracks(buf: bytes | None) -> list[dict]:
    """The tracks of a container; a ``Broken`` one raises."""
    if not buf:
        return []
    try:
        root, room = _tree(buf, 0, len(buf)), Room(len(buf))
        moov = _one(root, b"moov")[3]
        extends = {}
        for mvex in moov.get(b"mvex", []):
            for trex in mvex[3].get(b"trex", []):
                t, _, d, s, f = struct.unpack_from(">5I", buf, trex[1] + 4)
                extends[t] = (d, s, f)
        out = {}
        for trak in moov.get(b"trak", []):
            tk, mdia = _one(trak[3], b"tkhd"), _one(trak[3], b"mdia")[3]
            (track,) = struct.unpack_from(">I", buf, tk[1] + (20 if buf[tk[1]] else 12))
            width, height = struct.unpack_from(">II", buf, tk[2] - 8)
            md = _one(mdia, b"mdhd")[1]
            (scale,) = struct.unpack_from(">I", buf, md + (20 if buf[md] else 12))
            stbl = _one(mdia, b"minf", b"stbl")[3]
            stsd = _one(stbl, b"stsd")
            codec = buf[stsd[1] + 12 : stsd[1] + 16].decode("latin1") if struct.unpack_from(">I", buf, stsd[1] + 4)[0] else ""
            kind = buf[_one(mdia, b"hdlr")[1] + 8 :][:4].decode("latin1")
            offset, size, key, time = _samples(buf, stbl, room)
            out[track] = dict(track=track, kind=kind, codec=codec, width=width >> 16, height=height >> 16, scale=scale, parts=[(offset, size, key)], time=time)
        for moof in root.get(b"moof", []):
            for track, offset, size, key, time in _fragment(buf, moof, extends, room):
                if track in out:
                    out[track]["parts"].append((offset, size, key))
                    out[track]["time"] += time
    except (struct.error, IndexError) as e:
        raise Broken(str(e)) from e
    rows = []
    for t in out.values():
        offset, size, key = (np.concatenate(x) for x in zip(*t.pop("parts")))
        if len(offset) and ((offset < 0) | (offset + size > len(buf))).any():
            raise Broken("a sample lies outside the file")
        scale = t.pop("scale")
        time = t.pop("time")
        rows.append(t | dict(seconds=time / scale if scale else None, samples=len(offset), keyframes=int(key.sum()), ranges=",".join(f"{a}:{b}" for a, b in zip(offset[key].tolist(), size[key].tolist()))))
    return rows


_COLS = {"track": pa.int32(), "kind": pa.string(), "codec": pa.string(), "width": pa.int32(), "height": pa.int32(), "seconds": pa.float64(), "samples": pa.int64(), "keyframes": pa.int64(), "ranges": pa.string()}
_SCHEMA = "track int, kind string, codec string, width int, height int, seconds double, samples bigint, keyframes bigint, ranges string, problem string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows, which = b.column(0), [], []
        col = b.column(1)
        for k in range(b.num_rows):
            try:
                got = tracks(col[k].as_py())
            except Broken as e:
                got = [{"problem": str(e)}]
            rows += got
            which += [k] * len(got)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *[pa.array([r.get(c) for r in rows], t) for c, t in _COLS.items()], pa.array([r.get("problem") for r in rows], pa.string())], [b.schema.names[0], *_COLS, "problem"])


def media_columns(files: DataFrame, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """One row a track of each container: track, kind, codec, width, height, seconds, samples, keyframes, ranges (the key
    frames' "offset:size" in file order, joined by commas) and problem (null).

    Defined cases: null and empty data give no row; data that isn't a well-formed container gives one row with the
    problem named and all else null, and so does one whose tables count more samples than it has bytes; boxes may nest to
    any depth; samples without a sync table are all key frames; ids may be null or repeated, and of any type;
    other columns are ignored; an empty table gives no rows."""
    src = files.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{data_col}`").cast("binary").alias("data"))
    return src.mapInArrow(_walk, f"`{id_col}` {src.schema[0].dataType.simpleString()}, {_SCHEMA}")


# A muxer, so that tables without media can stand in for some: a row's bytes become the payload.

SAMPLE, GROUP, CHUNK, DELTA, SCALE = 512, 8, 4, 3000, 90000
CODECS = ("avc1", "hvc1", "av01")


def _box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def _full(kind: str, fmt: str, *values: int, version: int = 0, flags: int = 0, rest: bytes = b"") -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), struct.pack(">" + fmt, *values), rest)


def mux(payload: bytes, number: int) -> bytes:
    """A container of one video track around ``payload``: samples of SAMPLE bytes, a key frame every GROUP.  By
    ``number``: tables first, media first (64-bit places), or fragments of 2 * GROUP samples."""
    n = -(-len(payload) // SAMPLE)
    sizes = [min(SAMPLE, len(payload) - SAMPLE * k) for k in range(n)]
    layout, codec = number % 3, CODECS[number // 3 % 3]
    ftyp = _box("ftyp", b"isom", struct.pack(">I", 512), b"isomiso6")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

    def moov(count: int, places: list[int], wide: bool, extends: bool) -> bytes:
        entry = _box(codec, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 640, 360), bytes(50))
        keys = range(1, count + 1, GROUP)
        runs = [(1, CHUNK, 1)] if count >= CHUNK else []
        if count % CHUNK:
            runs.append((count // CHUNK + 1, count % CHUNK, 1))
        stbl = _box(
            "stbl", _full("stsd", "I", 1, rest=entry), _full("stts", "I", bool(count), rest=struct.pack(">II", count, DELTA) if count else b""),
            _full("stss", "I", len(keys), rest=struct.pack(f">{len(keys)}I", *keys)), _full("stsc", "I", len(runs), rest=b"".join(struct.pack(">3I", *r) for r in runs)),
            _full("stsz", "II", 0, count, rest=struct.pack(f">{count}I", *sizes[:count])), _full("co64" if wide else "stco", "I", len(places), rest=struct.pack(f">{len(places)}{'Q' if wide else 'I'}", *places)),
        )
        mdia = _box("mdia", _full("mdhd", "IIIIHH", 0, 0, SCALE, count * DELTA, 0x55C4, 0), _full("hdlr", "I4s", 0, b"vide", rest=bytes(12) + b"v\0"), _box("minf", stbl))
        tkhd = _full("tkhd", "IIIII", 0, 0, 1, 0, count * DELTA, flags=3, rest=bytes(16) + matrix + struct.pack(">II", 640 << 16, 360 << 16))
        mvex = _box("mvex", _full("trex", "5I", 1, 1, DELTA, SAMPLE, 0x10000)) if extends else b""
        return _box("moov", _full("mvhd", "IIIIIH", 0, 0, SCALE, count * DELTA, 0x10000, 0x100, rest=bytes(10) + matrix + bytes(24) + struct.pack(">I", 2)), _box("trak", tkhd, mdia), mvex)

    if layout == 2:
        out = [ftyp, moov(0, [], False, True)]
        for k in range(0, n, 2 * GROUP):
            part = sizes[k : k + 2 * GROUP]

            def moof(ahead: int) -> bytes:
                rows = b"".join(struct.pack(">II", s, 0x2000000 if (k + i) % GROUP == 0 else 0x1010000) for i, s in enumerate(part))
                return _box("moof", _full("mfhd", "I", k // (2 * GROUP) + 1), _box("traf", _full("tfhd", "I", 1, flags=0x20000), _full("trun", "Ii", len(part), ahead, flags=0x601, rest=rows)))

            head = len(moof(0)) + 8
            out += [moof(head), _box("mdat", payload[k * SAMPLE : (k + 2 * GROUP) * SAMPLE])]
        return b"".join(out)
    places = list(range(0, len(payload), SAMPLE * CHUNK))
    wide = layout == 1
    base = len(ftyp) + 8 + (0 if wide else len(moov(n, places, wide, False)))
    tables = moov(n, [base + p for p in places], wide, False)
    media = _box("mdat", payload)
    return ftyp + (media + tables if wide else tables + media)


def muxed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, data): each row's text as the payload of a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            while lo < b.num_rows:  # small batches: the bytes are held twice
                part = b.slice(lo, 256)
                data = [None if i is None or t is None else mux(t.encode("utf-8"), i) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], [id_col, "data"])
                lo += 256

    src = rows.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    return src.mapInArrow(run, f"`{id_col}` bigint, data binary")


def op6(spark, sf_dir: str) -> DataFrame:
    """No table holds media, so every page is muxed first; then the containers are walked."""
    return media_columns(muxed(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html"), "page_id")


SQL = f"""
with p as (select page_id, octet_length(encode(html)) as len, page_id % 3 as layout, page_id // 3 % 3 as c from pages),
     q as (select *, (len + {SAMPLE - 1}) // {SAMPLE} as n from p),
     r as (select *, (n + {GROUP - 1}) // {GROUP} as kf, (n + {CHUNK - 1}) // {CHUNK} as ch, (n >= {CHUNK})::int + (n % {CHUNK} > 0)::int as runs from q),
     k as (select *, unnest(range(kf)) as i from r),
     o as (select page_id, i, least({SAMPLE}, len - {SAMPLE * GROUP} * i) as size,
                  case layout when 0 then 524 + 8 + 4 * kf + 12 * runs + 4 * n + 4 * ch + {SAMPLE * GROUP} * i
                              when 1 then 32 + {SAMPLE * GROUP} * i
                              else 556 + (i // 2) * (76 + {2 * GROUP} * {SAMPLE + 8}) + 76 + 8 * least({2 * GROUP}, n - {2 * GROUP} * (i // 2)) + (i % 2) * {SAMPLE * GROUP} end as off from k),
     s as (select page_id, string_agg(off || ':' || size, ',' order by i) as ranges from o group by page_id)
select page_id, 1::int as track, 'vide' as kind, ['avc1', 'hvc1', 'av01'][c + 1] as codec, 640::int as width, 360::int as height,
       n * {DELTA} / {SCALE}::double as seconds, n::bigint as samples, kf::bigint as keyframes, coalesce(ranges, '') as ranges, null::varchar as problem
from r left join s using (page_id)
"""
