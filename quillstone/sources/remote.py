"""Sources over HTTP: a served store's catalogue, its hyperedges by type, its evidence by session, and its snapshots.

Every request is a partition of its own, so executors fetch side by side; answers are EDN or JSON, as the server says."""

from __future__ import annotations

import io
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .edn import Reader, sanitise


def fetch(url: str, timeout: float = 60, body: dict | None = None) -> dict:
    """An answer as a map without the colons of its keywords."""
    data = None if body is None else json.dumps(body).encode()
    ask = urllib.request.Request(url, data, {"Accept": "application/edn, application/json"} | ({"Content-Type": "application/json"} if data else {}))
    with urllib.request.urlopen(ask, timeout=timeout) as got:
        text, kind = got.read().decode("utf-8"), got.headers.get_content_type()
    return bare(json.loads(text) if kind == "application/json" else Reader(io.StringIO(sanitise(text)[0])).value())


def bare(x):
    """Maps with their keyword keys as names."""
    if isinstance(x, dict):
        return {k[1:] if isinstance(k, str) and k.startswith(":") else k: bare(v) for k, v in x.items()}
    return [bare(v) for v in x] if isinstance(x, list) else x


def url(base: str, path: str, **query) -> str:
    return f"{base.rstrip('/')}/api/alpha/{path}" + (f"?{urllib.parse.urlencode(query)}" if query else "")


def probe(base: str, type: str, timeout: float = 20, get: Callable[..., dict] = fetch) -> tuple[str, str | None, int | None, str]:
    """(type, kind, count, status): ``ok`` for a hyperedge type with some, ``inactive`` for any other answer, and ``failed``
    where there is none: its count is unknown, not 0.  A failure is tried once more."""
    for _ in range(2):
        try:
            got = get(url(base, "census", type=type), timeout)
        except (OSError, ValueError):
            continue
        if not got or got.get("error"):
            continue
        kind, n = str(got.get("kind") or "").lstrip(":") or None, int(got.get("count") or 0)
        return type, kind, n, "ok" if kind == "hyperedge" and n > 0 else "inactive"
    return type, None, None, "failed"


def census(spark: SparkSession, base: str, types: Iterable[str], timeout: float = 20) -> DataFrame:
    """``probe`` of every type, side by side."""
    wanted = list(dict.fromkeys(types))
    rows = spark.createDataFrame([(t,) for t in wanted], "type string").repartition(max(1, min(len(wanted), 8)))

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([probe(base, t, timeout) for t in b["type"]], columns=["type", "kind", "count", "status"]).astype({"count": "Int64"})

    return rows.mapInPandas(run, "type string, kind string, count bigint, status string")


class _Ask(InputPartition):
    def __init__(self, name: str, url: str):
        self.name, self.url = name, url


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.asks, self.key, self.timeout = json.loads(options["asks"]), options["key"], float(options.get("timeout", "120"))

    def partitions(self):
        return [_Ask(name, where) for name, where in self.asks]

    def read(self, part: _Ask):
        try:
            docs = fetch(part.url, self.timeout).get(self.key) or []
        except (OSError, ValueError) as e:
            yield part.name, None, None, str(e)[:200]
            return
        for n, d in enumerate(docs):
            yield part.name, n, json.dumps(d, ensure_ascii=False), None


class HttpSource(DataSource):
    """(name, ordinal, doc, error): the documents under ``key`` of each answer; a request that fails is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "served-http"

    def schema(self) -> str:
        return "name string, ordinal bigint, doc string, error string"

    def reader(self, schema):
        return _HttpReader(self.options)


def _read(spark: SparkSession, asks: list[tuple[str, str]], key: str, timeout: float) -> DataFrame:
    spark.dataSource.register(HttpSource)
    return spark.read.format("served-http").option("asks", json.dumps(asks)).option("key", key).option("timeout", str(timeout)).load()


def catalogue(spark: SparkSession, base: str, timeout: float = 60) -> DataFrame:
    return _read(spark, [("types", url(base, "types"))], "types", timeout)


def hyperedges(spark: SparkSession, base: str, types: Iterable[str], timeout: float = 300) -> tuple[DataFrame, DataFrame]:
    """(documents, census).  Types whose census failed are in it and aren't fetched, so an export is complete only where it
    has none."""
    found = census(spark, base, types).collect()  # one row a type
    asks = [(r.type, url(base, "hyperedges", type=r.type, limit=r["count"])) for r in found if r.status == "ok"]
    return _read(spark, asks, "hyperedges", timeout), spark.createDataFrame(found, "type string, kind string, count bigint, status string")


def evidence(spark: SparkSession, base: str, timeout: float = 120) -> DataFrame:
    """All entries, session by session."""
    got = fetch(url(base, "evidence/sessions"), timeout).get("sessions") or []
    asks = [(s["session-id"], url(base, "evidence", **{"session-id": s["session-id"], "limit": s["count"]})) for s in got if s.get("session-id") and s.get("count", 0) > 0]
    return _read(spark, asks, "entries", timeout)


def snapshot(base: str, scope: str, timeout: float = 300) -> str:
    """Have the server write a snapshot; the path of its file, which ``EdnSource`` reads."""
    got = fetch(url(base, "snapshot"), timeout, {"scope": scope})
    if not got.get("ok?"):
        raise RuntimeError(f"snapshot failed: {got}")
    return got["snapshot/file"]
