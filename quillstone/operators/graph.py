"""Reads of entities, relations and hyperedges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import names
from ..functions.errors import BadRequest, NotFound, Refused


@dataclass
class Listing:
    rows: DataFrame
    count: int
    count_exact: bool | None = None


# hyperedges


def by_type(edges: DataFrame, type: str, repo: str | None = None, source_file: str | None = None) -> DataFrame:
    rows = edges.where(F.col("type") == names.canonical(type))
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    if source_file is not None:
        rows = rows.where(F.col("source_file") == source_file)
    return rows


def window(rows: DataFrame, limit: int | None = None, latest: bool = False) -> DataFrame:
    """The first ``limit`` edges by id, or the one latest by timestamp (the greatest id of equal ones)."""
    if latest:
        return rows.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(1)
    rows = rows.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def with_endpoint(edges: DataFrame, *targets: str, type: str | None = None) -> DataFrame:
    """Edges that touch any of the targets, each once."""
    hit = F.arrays_overlap("endpoints", F.array(*[F.lit(t) for t in targets])) if len(targets) > 1 else F.array_contains("endpoints", targets[0])
    rows = edges.where(hit)
    return rows if type is None else rows.where(F.col("type") == names.canonical(type))


def hyperedges(edges: DataFrame, entities: DataFrame | None = None, type: str | None = None, end: str | None = None, limit: int | str | None = None, repo: str | None = None, source_file: str | None = None, latest: bool = False, include_total: bool = True) -> Listing:
    """Edges of a type and/or at an end.  The count is the type's true total where it is asked for without other filters,
    else the number of rows returned; an end that is a UUID is searched by the entity's name too."""
    n = names.limit(limit)
    if type is None and end is None:
        raise BadRequest("type-or-end-required")
    if end is not None:
        targets = [end]
        if entities is not None and entities.sparkSession.range(1).select(F.lit(end).rlike(names.UUID)).first()[0]:
            found = fetch_entity(entities, end).select("name").first()
            targets += [found.name] if found else []
        rows = window(with_endpoint(edges, *dict.fromkeys(targets), type=type), n)
        return Listing(rows, rows.count())
    rows = by_type(edges, type, repo, source_file)
    shown = window(rows, n, latest)
    if include_total and repo is None and source_file is None and not latest:
        return Listing(shown, rows.count(), True)
    return Listing(shown, shown.count(), include_total)


def exploded(edges: DataFrame) -> DataFrame:
    """(id, type, endpoint), one row an occurrence."""
    return edges.select("id", "type", F.explode("endpoints").alias("endpoint"))


def endpoint_counts(edges: DataFrame) -> DataFrame:
    return exploded(edges).groupBy("endpoint").agg(F.count("*").alias("count"))


def ego(edges: DataFrame, endpoint: str) -> DataFrame:
    """Distinct other endpoints of the edges at ``endpoint``."""
    return with_endpoint(edges, endpoint).select(F.explode("endpoints").alias("endpoint")).where(F.col("endpoint") != endpoint).distinct()


def census(edges: DataFrame, *by: str) -> DataFrame:
    """Counts by type, or other columns; null is a group."""
    return edges.groupBy(*(by or ("type",))).agg(F.count("*").alias("count"))


# entities


def entities_of(entities: DataFrame, type: str, limit: int | None = None) -> DataFrame:
    rows = entities.where(F.col("type") == names.canonical(type)).orderBy(F.coalesce("id", F.lit("")))
    return rows if limit is None else rows.limit(limit)


def latest_by_name(entities: DataFrame, type: str, limit: int | None = None, relations: DataFrame | None = None) -> DataFrame:
    """One entity a name (the least id), in order of name; with ``relations``, only those with a sigil."""
    rows = entities.where(F.col("type") == names.canonical(type))
    if relations is not None:
        rows = rows.join(relations.where("type = 'pattern/has-sigil'").select(F.col("src").alias("id")), "id", "left_semi")
    rest = [c for c in entities.columns if c != "name"]
    rows = rows.groupBy("name").agg(F.min_by(F.struct(*rest), "id").alias("first")).select("first.*", "name").select(*entities.columns).orderBy("name")
    return rows if limit is None else rows.limit(max(1, limit))


def fetch_entity(entities: DataFrame, key: str) -> DataFrame:
    """The entity with this id, else this name, else this external id (the least id of several)."""
    leg = F.when(F.col("id") == key, 1).when(F.col("name") == key, 2).when(F.col("external_id") == key, 3)
    return entities.withColumn("leg", leg).where("leg is not null").orderBy("leg", "id").limit(1).drop("leg")


def by_external(entities: DataFrame, source: str | None, external_id: str | None) -> DataFrame:
    """The one entity of a source and external id: none is not found, several are ambiguous."""
    if not source or not external_id:
        raise Refused(4, "source-and-external-id-required")
    rows = entities.where((F.col("source") == source) & (F.col("external_id") == external_id)).orderBy("id")
    some = [r.id for r in rows.select("id").take(100)]
    if not some:
        raise NotFound()
    if len(some) > 1:
        raise Refused(1, "ambiguous-external-id", candidates=some)
    return rows


def ambiguous_externals(entities: DataFrame) -> DataFrame:
    """(source, external_id, candidates) that name several entities."""
    return entities.groupBy("source", "external_id").agg(F.array_sort(F.collect_list("id")).alias("candidates")).where("size(candidates) > 1")


# relations


def relations_of(relations: DataFrame, type: str | None = None, types: list[str] | None = None, src: str | None = None, dst: str | None = None, limit: int | None = None) -> DataFrame:
    """All filters together; ``types`` is any of them, each relation once."""
    if not (type or types or src or dst):
        raise BadRequest("type-from-or-to-required")
    kinds = [names.canonical(t) for t in ([type] if type else []) + (types or [])]
    if kinds:
        relations = relations.where(names.any_equals(F.col("type"), list(dict.fromkeys(kinds))))
    if src is not None:
        relations = relations.where(F.col("src") == src)
    if dst is not None:
        relations = relations.where(F.col("dst") == dst)
    rows = relations.orderBy("id")
    return rows if limit is None else rows.limit(limit)


def hydrate(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities at either end of the relations, once each."""
    ends = relations.select(F.col("src").alias("id")).union(relations.select("dst"))
    return entities.join(ends, "id", "left_semi")


def missing_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, endpoint) of relation ends that no entity has."""
    ends = relations.select("id", F.explode(F.array("src", "dst")).alias("endpoint"))
    return ends.join(entities.select(F.col("id").alias("endpoint")), "endpoint", "left_anti").select("id", "endpoint")


def resolve_ends(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """``wanted`` (key) with the id it names: an existing id, else the least id of that name, else a UUID as it stands."""
    by_name = entities.groupBy(F.col("name").alias("key")).agg(F.min("id").alias("named"))
    by_id = entities.select(F.col("id").alias("key"), F.col("id").alias("own"))
    out = wanted.join(by_id, "key", "left").join(by_name, "key", "left")
    return out.select(*wanted.columns, F.coalesce("own", "named", F.when(F.col("key").rlike(names.UUID), F.col("key"))).alias("resolved"))


# inhabitation


def inhabited(bindings: list[dict], entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, kind, inhabited) in the order of ``bindings``: an entity binding {kind, type} holds where some entity has the type; a
    hyperedge binding {kind, type, endpoint_types} where some edge of the type has, for each endpoint type, an endpoint
    that is an entity of that type.  One plan for all bindings."""
    spark = entities.sparkSession
    rows = [(n, b.get("kind"), names.canonical(b.get("type")), [names.canonical(t) for t in b.get("endpoint_types") or []]) for n, b in enumerate(bindings)]
    asked = spark.createDataFrame(rows, "n int, kind string, type string, wanted array<string>")
    of_entity = names.any_equals(F.col("type"), sorted({r[2] for r in rows if r[1] == "entity" and r[2]}) or [""])
    # types are made distinct before they meet the request: a type of a billion entities is one row there
    have = asked.where("kind = 'entity'").join(entities.where(of_entity).select("type").distinct(), "type", "left_semi").select("n")
    kinds = sorted({t for r in rows if r[1] == "hyperedge" for t in r[3]})
    of_type = names.any_equals(F.col("type"), sorted({r[2] for r in rows if r[1] == "hyperedge" and r[2]}) or [""])
    of_ends = names.any_equals(F.col("type"), sorted({r[2] for r in rows if r[1] == "hyperedge" and r[2] and r[3]}) or [""])
    some = edges.where(of_type)
    # a kind is a bit, 32 to a number: partial results of an edge combine in place
    nth = F.create_map(*[F.lit(x) for k, t in enumerate(kinds) for x in (t, k)])[F.col("type")] if kinds else F.lit(0)
    of_kind = entities.where(names.any_equals(F.col("type"), kinds or [""])).select(F.col("id").alias("endpoint"), nth.alias("nth"))
    ends = exploded(edges.where(of_ends)).withColumnRenamed("type", "edge_type").join(of_kind, "endpoint")
    bit = F.expr("shiftleft(1L, nth % 32)")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("nth") / 32) == w, bit)), F.lit(0)).alias(f"w{w}") for w in range(max(1, -(-len(kinds) // 32)))]
    found = ends.groupBy("id", "edge_type").agg(*words).drop("id").distinct()
    found = found.select("edge_type", F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"w{k // 32}").bitwiseAND(F.lit(1 << k % 32)) != 0, F.lit(t)) for k, t in enumerate(kinds)])).alias("found"))
    typed = asked.where("kind = 'hyperedge' and size(wanted) > 0").join(found, F.col("type") == F.col("edge_type")).where("size(array_except(wanted, found)) = 0").select("n")
    plain = asked.where("kind = 'hyperedge' and size(wanted) = 0").join(some.select("type").distinct(), "type", "left_semi").select("n")
    yes = have.union(typed).union(plain).distinct().withColumn("yes", F.lit(True))
    return asked.join(yes, "n", "left").select("n", "kind", F.coalesce("yes", F.lit(False)).alias("inhabited")).orderBy("n")


# types


def type_registry(*typed: tuple[DataFrame, str, str]) -> DataFrame:
    """(kind, id, parent) of every type in the given (rows, column, kind) and of its parent, the keyword's namespace."""
    every = None
    for rows, column, kind in typed:
        one = rows.select(F.lit(kind).alias("kind"), F.col(column).alias("id")).where("id is not null").distinct()
        every = one if every is None else every.union(one)
    pairs = every.withColumn("parent", names.namespace_col(F.col("id")))
    parents = pairs.where("parent is not null").select("kind", F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"))
    return pairs.unionByName(parents).groupBy("kind", "id").agg(F.max("parent").alias("parent"))

