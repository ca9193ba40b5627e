"""EDN files as a data source: one document a row, as JSON, read one at a time.

Keywords keep their colon (":a/b") so that they can still be told from strings.  A file holds a vector of maps, a stream of
maps, or one map with a vector of maps under some key."""

from __future__ import annotations

import glob
import io
import json
import os
import re
from collections.abc import Iterator
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_END = object()
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r", "backspace": "\b", "formfeed": "\f"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}


class Malformed(ValueError):
    """Not EDN."""


class Reader:
    """A pull parser: holds one block of the file and the value in hand."""

    def __init__(self, source: TextIO, block: int = 1 << 16):
        self.source, self.block, self.buf, self.at = source, block, "", 0

    def peek(self) -> str:
        if self.at >= len(self.buf):
            self.buf, self.at = self.source.read(self.block), 0
        return self.buf[self.at] if self.buf else ""

    def next(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def skip(self) -> str:
        """The next significant character, not consumed."""
        while True:
            c = self.peek()
            if c and (c.isspace() or c == ","):
                self.at += 1
            elif c == ";":
                while self.peek() not in ("\n", ""):
                    self.at += 1
            else:
                return c

    def word(self) -> str:
        out = []
        while (c := self.peek()) and not c.isspace() and c not in ',;()[]{}"':
            out.append(self.next())
        return "".join(out)

    def until(self, close: str) -> Iterator:
        while True:
            c = self.skip()
            if c == close:
                self.at += 1
                return
            if c == "":
                raise Malformed(f"{close} is missing")
            if (v := self.value()) is not _END:
                yield v

    def string(self) -> str:
        out = []
        while True:
            c = self.next()
            if c == "":
                raise Malformed("a string isn't closed")
            if c == '"':
                return "".join(out)
            if c == "\\":
                e = self.next()
                if e == "u":
                    out.append(chr(int("".join(self.next() for _ in range(4)), 16)))
                elif e in _ESCAPES:
                    out.append(_ESCAPES[e])
                else:
                    raise Malformed(f"escape \\{e}")
            else:
                out.append(c)

    def value(self):
        """The next value; ``_END`` for a discarded one or at the end."""
        c = self.skip()
        if c == "":
            return _END
        if c == '"':
            self.at += 1
            return self.string()
        if c in "([":
            self.at += 1
            return list(self.until(_CLOSE[c]))
        if c == "{":
            self.at += 1
            return self.map()
        if c in ")]}":
            raise Malformed(f"unexpected {c}")
        if c == "\\":
            self.at += 1
            name = self.next() + ("" if self.peek() in ")]}" else self.word())
            return _CHARS.get(name) or (chr(int(name[1:], 16)) if re.fullmatch("u[0-9a-fA-F]{4}", name) else name)
        if c == "#":
            self.at += 1
            return self.dispatch()
        return self.atom(self.word())

    def map(self) -> dict:
        items = list(self.until("}"))
        if len(items) % 2:
            raise Malformed("a map with an odd number of forms")
        return {k if isinstance(k, str) else json.dumps(k, ensure_ascii=False): v for k, v in zip(items[::2], items[1::2])}

    def dispatch(self):
        c = self.peek()
        if c == "{":
            self.at += 1
            return set_of(self.until("}"))
        if c == "_":
            self.at += 1
            while self.value() is _END and self.skip():
                pass
            return _END
        tag = self.word()
        v = self.value()
        if tag.rpartition("/")[2] in ("inst", "instant") and isinstance(v, str):
            return instant(v)
        return v if tag == "uuid" else {"tag": tag, "value": v}

    def atom(self, w: str):
        if w in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[w]
        if re.fullmatch(r"[+-]?\d+N?", w):
            return int(w.rstrip("N"))
        if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", w):
            return float(w.rstrip("M"))
        if not w:
            raise Malformed("an empty token")
        return w


def set_of(items) -> list:
    """Sets become vectors in canonical order."""
    return sorted(items, key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False))


def instant(text: str) -> str:
    """To the millisecond, as the writer's clock type holds it."""
    return re.sub(r"(\.\d{3})\d+", r"\1", text)


def sanitise(text: str) -> tuple[str, int]:
    """Auto-resolved keywords (::k) as plain ones outside strings, characters and comments, and how many there were."""
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        if m[1] is None:
            return m[0]
        n += 1
        return m[0][1:]

    out = re.sub(r'"(?:[^"\\]|\\.)*"|\\.|;[^\n]*|(?<![^\s,()\[\]{}#])(::)(?=[^\s:])', one, text, flags=re.S)
    return out, n


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|\\.|;[^\n]*\n|[^"\\;]+', re.S)


class Sanitised:
    """A source whose text is sanitised as it is read: what a string, a comment or a word needs of the next block waits for it."""

    def __init__(self, source: TextIO):
        self.source, self.rest, self.count = source, "", 0

    def read(self, block: int = 1 << 16) -> str:
        while True:
            got = self.source.read(block)
            self.rest += got
            cut = len(self.rest) if not got else self._whole()
            out, n = sanitise(self.rest[:cut])
            self.rest, self.count = self.rest[cut:], self.count + n
            if out or not got:
                return out

    def _whole(self) -> int:
        """Up to where no token is begun and not ended."""
        at = safe = 0
        while at < len(self.rest) and (m := _PIECE.match(self.rest, at)):
            blank = next((k for k in range(m.end() - 1, at - 1, -1) if self.rest[k].isspace()), None) if self.rest[at] not in '"\\;' else None
            safe = blank + 1 if blank is not None else m.end() if self.rest[at] == ";" else safe
            at = m.end()
        return safe


def documents(source: TextIO, key: str | None = None) -> Iterator[dict]:
    """The maps of a file, one at a time; of one map with vectors of maps, those under ``key`` (or the first such)."""
    r = Reader(source)
    c = r.skip()
    if c == "[":
        r.at += 1
        yield from (d for d in r.until("]") if isinstance(d, dict))
        return
    first = True
    while (v := r.value()) is not _END or r.skip():
        if v is _END:
            continue
        if first and isinstance(v, dict):
            lists = {k: x for k, x in v.items() if isinstance(x, list) and x and all(isinstance(d, dict) for d in x)}
            if lists and (key in v if key else not any(k.endswith("/id") for k in v)):
                yield from lists[key if key else next(iter(lists))]
                return
        first = False
        if isinstance(v, dict):
            yield v


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _EdnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key, self.clean = options["path"], options.get("key"), options.get("sanitise", "false") == "true"

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.edn")) if os.path.isdir(self.path) else glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, part: _File):
        with open(part.path, encoding="utf-8") as f:
            for n, d in enumerate(documents(Sanitised(f) if self.clean else f, self.key)):
                yield part.path, n, json.dumps(d, ensure_ascii=False)


def read(spark: SparkSession, path: str, key: str | None = None, clean: bool = False, files: str = "*.{edn,txt}") -> DataFrame:
    """(file, ordinal, doc) of the files of any file system that Spark reads: it lists them side by side and puts small ones
    into one task.  A file is a row on the way, so one beyond 2 GB needs ``EdnSource``, which streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "ordinal", "doc"]
        for b in batches:
            for file, data in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                text = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8")
                rows = [json.dumps(d, ensure_ascii=False) for d in documents(Sanitised(text) if clean else text, key)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("path", "content").mapInArrow(run, "file string, ordinal bigint, doc string")


class EdnSource(DataSource):
    """``spark.read.format("edn").load(path)``: (file, ordinal, doc).  Options: key (of the vector to read), sanitise."""

    @classmethod
    def name(cls) -> str:
        return "edn"

    def schema(self) -> str:
        return "file string, ordinal bigint, doc string"

    def reader(self, schema):
        return _EdnReader(self.options)


def write(docs: DataFrame, path: str, column: str = "doc") -> None:
    """Documents (JSON strings) as a folder of EDN, one file a partition and one document a line: what ``read`` takes as a
    stream of maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([edn(json.loads(x)) for x in b.column(0).to_pylist() if x is not None], pa.string())], ["value"])

    docs.select(column).mapInArrow(run, "value string").write.text(path)


def write_edn(path: str, docs: Iterator[dict]) -> int:
    """A vector of documents in EDN, written as they come; how many there were."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for d in docs:
            f.write(("\n" if n else "") + edn(d))
            n += 1
        f.write("]\n")
    return n


def edn(v) -> str:
    if v is None:
        return "nil"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, str):
        return v if re.fullmatch(r":[^\s,:()\[\]{}\"]+", v) else json.dumps(v, ensure_ascii=False)
    if isinstance(v, dict):
        return "{" + ", ".join(f"{edn(k)} {edn(x)}" for k, x in v.items()) + "}"
    return "[" + " ".join(edn(x) for x in v) + "]"
