"""Memory assertions: edges joined with the evidence they enter, by endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import names
from ..functions.errors import BadRequest
from . import evidence as ev

CEILING = 5000


def components(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges with their entry; an edge that names none, or one that doesn't exist, drops out.  The entry is compact: of a
    body that is a map only its hook."""
    entry = evidence.select(F.col("id").alias("entry_id"), F.col("type").alias("entry_type"), "claim_type", "author", "session_id", F.get_json_object("body", "$.hook").alias("hook"))
    return edges.where("type = 'memory/assert' and entry is not null").join(entry, F.col("entry") == F.col("entry_id")).drop("entry")


def build(edges: DataFrame, evidence: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """The projection's rows, refused above its hard ceiling."""
    return within(components(edges, evidence), ceiling)


def within(rows: DataFrame, ceiling: int = CEILING) -> DataFrame:
    if rows.limit(ceiling + 1).count() > ceiling:
        raise BadRequest("projection-too-large", ceiling=ceiling)
    return rows


def check(endpoints: list[str], limit: int | None) -> tuple[list[str], int]:
    asked = list(dict.fromkeys(endpoints))
    if not 1 <= len(asked) <= 20:
        raise BadRequest("endpoints-out-of-range", endpoints=len(asked))
    return asked, names.limit(limit, 10, 100, layered=False)


def _asked(rows: DataFrame, endpoints: list[str]) -> DataFrame:
    return rows.sparkSession.createDataFrame(list(enumerate(endpoints)), "n int, endpoint string")


def project(components: DataFrame, endpoints: list[str], limit: int | None = None) -> DataFrame:
    """Components by requested endpoint, in the order of the request: the first ``limit`` by edge id of each; an endpoint
    without any has one row of nulls."""
    asked, n = check(endpoints, limit)
    hit = components.where(F.arrays_overlap("endpoints", F.array(*[F.lit(e) for e in asked])))
    rows = hit.select("*", F.explode(F.array_distinct("endpoints")).alias("endpoint")).join(F.broadcast(_asked(hit, asked)), "endpoint")
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("endpoint").orderBy("id"))).where(F.col("nth") <= n).drop("n")
    return _asked(hit, asked).join(first, "endpoint", "left").orderBy("n", "nth")


def audit(rows: DataFrame) -> DataFrame:
    """Of a projection's rows, by requested endpoint: edges selected, those with their entry, those without; and over all
    the distinct edges and entries.  On the current basis edges without an entry were never selected."""
    all_ = rows.agg(F.countDistinct("id").alias("edges"), F.countDistinct("entry_id").alias("entries"))
    by = rows.groupBy("n", "endpoint").agg(F.count("id").alias("selected"), F.count("entry_id").alias("components"), F.count(F.when(F.col("id").isNotNull() & F.col("entry_id").isNull(), 1)).alias("missing"))
    return by.crossJoin(F.broadcast(all_)).orderBy("n")


def _hits(edges: DataFrame, asked: list[str]) -> DataFrame:
    """Assertions by asked endpoint, one row each."""
    hit = edges.where("type = 'memory/assert'").where(F.arrays_overlap("endpoints", F.array(*[F.lit(e) for e in asked])))
    return hit.select("*", F.explode(F.array_distinct("endpoints")).alias("endpoint")).join(F.broadcast(_asked(hit, asked)), "endpoint")


def fitting(edges: DataFrame, endpoints: list[str], limit: int | None = None) -> DataFrame:
    """The edges, refused where the endpoints have more matches than endpoints times limit: the served route's rule."""
    asked, n = check(endpoints, limit)
    bound = len(asked) * n
    if _hits(edges, asked).limit(bound + 1).count() > bound:
        raise BadRequest("projection-overflow", maximum=bound)
    return edges


def project_as_of(edges: DataFrame, evidence: DataFrame, endpoints: list[str], limit: int | None = None) -> DataFrame:
    """The same over edges as they were, with the evidence as it is, however many match.  Edges without an entry still
    count against the limit, as rows without one."""
    asked, n = check(endpoints, limit)
    rows = _hits(edges, asked)
    known = evidence.select(F.col("id").alias("entry_id"), F.col("type").alias("entry_type"), "claim_type", "author", "session_id", F.get_json_object("body", "$.hook").alias("hook"))
    full = rows.join(known, F.col("entry") == F.col("entry_id"), "left").withColumn("nth", F.row_number().over(Window.partitionBy("endpoint").orderBy("id"))).drop("n")
    return _asked(rows, asked).join(full.where(F.col("nth") <= n), "endpoint", "left").orderBy("n", "nth")


def search(evidence: DataFrame, type: str | None = None, author: str | None = None, since: str | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Structured memory search: any of the tags, whole keywords compared; newest first so that the result is defined."""
    rows = ev.select(evidence, type=type, author=author, since=since, tags_exact=tags).dropDuplicates(["id"])
    return ev.newest(rows, names.memory_limit(limit))


FRAME = "recorded, not necessarily current"
