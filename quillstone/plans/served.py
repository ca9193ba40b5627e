"""The served surface: stores written from the fixtures, read and changed through the engine."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from ..api import Engine
from ..sources import adapters
from ..sources.adapters import read
from ..sources.scratch import folder
from ..sources.store import Store
from .models import ENT, EV, HX, LOG, REL, as_of
from .registry import query
from .temporal import S, V

_kept: dict[tuple, Engine] = {}
START = datetime(2026, 1, 1, tzinfo=timezone.utc)


class Clock:
    """A second later each time it is asked."""

    def __init__(self):
        self.now = START

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


def _new(spark, **how) -> Engine:
    return Engine(Store(spark, f"{folder(spark)}/served-{uuid.uuid4().hex}", Clock()), **how)


def _once(spark, d: str, name: str, fill) -> Engine:
    """A store that is written once a session."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = fill(_new(spark))
    return _kept[key]


def _thread(spark, d: str) -> DataFrame:
    """One thread through all customers."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(F.concat(F.lit("th-"), k).alias("id"), F.when(k > 0, F.concat(F.lit("th-"), k - 1)).alias("in_reply_to"))
    return rows.select("*", F.lit("thread").alias("type"), F.lit("step").alias("claim_type"), F.lit("crowd").alias("author"), F.lit("2020-01-01").alias("at"), F.lit("{}").alias("body"))


FILL = {
    "evidence": lambda spark, d: adapters.evidence(spark, d).unionByName(_thread(spark, d), allowMissingColumns=True),
    "hyperedges": lambda spark, d: adapters.hyperedges(spark, d).select("id", "type", "endpoints", "repo", "source_file"),
    "entities": adapters.entities,
    "relations": lambda spark, d: adapters.relations(spark, d).drop("from", "to"),
}


def served(spark, d: str, *tables: str) -> Engine:
    """A store of the session; a table is written whole when a query first reads it."""
    e = _once(spark, d, "graph", lambda e: e)
    new = [t for t in tables if not e.store.folders(t)]
    if new:
        e.store.commit({t: e.store.puts(t, FILL[t](spark, d)) for t in new})
    return e


def library(spark, d: str) -> Engine:
    """The documents as entries with a text, indexed by the catch-up."""

    def fill(e: Engine) -> Engine:
        docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("doc").alias("type"), F.col("lang").alias("author"), F.lit("2020-01-01").alias("at"), F.col("text").alias("body"))
        e.store.append_documents("evidence", docs)
        e.text_catch_up()
        e.store.compact()
        return e

    return _once(spark, d, "library", fill)


def one(spark, row: dict, *cols: str) -> DataFrame:
    return spark.createDataFrame([tuple(row[c] for c in cols)], ", ".join(f"{c} {'bigint' if isinstance(row[c], int) else 'string'}" for c in cols))


@query("select 'evidence' as tbl, ((select count(*) from events) + (select count(*) from customer))::bigint as n union all select 'hyperedges', count(distinct (l_returnflag, l_orderkey, l_partkey, l_suppkey)) from lineitem union all "
       "select 'entities', (select count(*) from part) + (select count(*) from customer) + (select count(*) from supplier) + 30 union all select 'relations', 25 + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from orders)")
def served_health(spark, d):
    got = served(spark, d, *FILL).health(deep=True)["tables"]
    return spark.createDataFrame([(t, got[t]) for t in ("evidence", "hyperedges", "entities", "relations")], "tbl string, n bigint")


@query(f"with {EV} select id, type, author, at from ev where id = 'e-17'")
def served_point(spark, d):
    return one(spark, served(spark, d, "evidence").evidence("e-17"), "id", "type", "author", "at")


@query(f"with {EV} select id, at, author from ev where type = 'click' and coalesce(ephemeral, false) = false and list_contains(tag_names, 'k1') order by at desc, id desc limit 25 offset 25")
def served_second_page(spark, d):
    e = served(spark, d, "evidence")
    ask = dict(limit=25, type="click", tags="k1", include_ephemeral="false", whole=False)
    at, ident = e.evidence_page(**ask).next_cursor
    return e.evidence_page(cursor_at=at, cursor_id=ident, **ask).entries.select("id", "at", "author")


@query(f"with {EV} select count(*)::bigint as n from ev where claim_type = 'step' and pattern_id = 'agent/p1' and coalesce(ephemeral, false) = false")
def served_count(spark, d):
    return spark.createDataFrame([(served(spark, d, "evidence").evidence_count(claim_type="step", pattern_id="agent/p1", include_ephemeral="false"),)], "n bigint")


@query(f"with {EV}, s as (select session_id, count(*) as n, max(at) as last from ev group by 1) select session_id, n::bigint as n from s order by last desc, session_id desc limit 40")
def served_sessions(spark, d):
    return served(spark, d, "evidence").evidence_sessions(40)[0].select("session_id", F.col("count").alias("n"))


@query("select 'th-' || c_custkey as id, c_custkey::bigint as depth from customer")
def served_long_chain(spark, d):
    last = read(spark, d, "customer").agg(F.max("c_custkey")).first()[0]
    return served(spark, d, "evidence").evidence_chain(f"th-{last}").select("id", "depth")


FOLD = r"d as (select doc_id::varchar as id, lang, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: len(t) >= 1) as toks from documents)"


@query(f"with {FOLD} select id from d where list_contains(toks, 'fur') or list_contains(toks, 'etre') or list_has_all(toks, ['y', 'racion'])")
def served_text_folds(spark, d):
    return library(spark, d).text_matches("für OR Étre OR y RACIÓN").select("id")


@query(f"with {FOLD} select id from d where lang = 'en' and contains(' ' || array_to_string(toks, ' ') || ' ', ' cc by nc 4 0 ') and not list_contains(toks, 'zzz')")
def served_text_phrase(spark, d):
    return library(spark, d).text_matches("cc-by-nc-4.0", author="en").select("id")


@query(f"with {FOLD}, " + """n as (select count(*) as n, avg(len(toks)) as avgdl, sum(list_contains(toks, 'uber')::int) as d0, sum(list_contains(toks, 'ete')::int) as d1 from d),
  s as (select id, len(toks) as dl, len(list_filter(toks, lambda t: t = 'uber')) as t0, len(list_filter(toks, lambda t: t = 'ete')) as t1 from d),
  r as (select id, -greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from s, n where t0 > 0 or t1 > 0)
  select id, round(score, 6) as score from r order by r.score, id limit 30""")
def served_text_rank(spark, d):
    return library(spark, d).text_search("über OR été", 30).select("id", F.round("score", 6).alias("score"))


@query(f"with {FOLD} select count(*)::bigint as rows, count(*)::bigint as indexed, 0::bigint as pending, sum(len(toks))::bigint as tokens, '2020-01-01' as last_at from d")
def served_text_stats(spark, d):
    return library(spark, d).text_stats()


@query(f"with {HX} select distinct id, repo, (select count(distinct id) from hx where type = 'order/A')::bigint as total from hx where type = 'order/A' order by id limit 20")
def served_edges_of_type(spark, d):
    got = served(spark, d, "hyperedges").hyperedges(type=":order/A", limit=20)
    return got.rows.select("id", "repo", F.lit(got.count).cast("bigint").alias("total"))


@query(f"with {HX} select distinct id, type from hx where list_contains(endpoints, 'part:5')")
def served_edges_at_end(spark, d):
    return served(spark, d, "hyperedges").edges_at("part:5").select("id", "type")


@query(f"with {ENT} select id, name from ent where type = 'party/supplier' order by name limit 50")
def served_entities_latest(spark, d):
    return served(spark, d, "entities").entities_latest("party/supplier", 50).select("id", "name")


@query(f"with {ENT} select id, name, type from ent where id = 'nation:3'")
def served_entity_by_name(spark, d):
    row = served(spark, d, "entities")
    name = row.entity("nation:3")["name"]
    return one(spark, row.entity(name), "id", "name", "type")


@query(f"with {REL} select id, src from rel where dst = 'nation:3' and type = 'geo/in-nation' order by id limit 100")
def served_relations_to(spark, d):
    return served(spark, d, "relations").relations(type="geo/in-nation", dst="nation:3")[0].select("id", "src")


@query(f"with {HX}, {ENT} select 'order/R' as type, count(distinct id)::bigint as n from hx where type = 'order/R' union all select 'geo/nation', count(*) from ent where type = 'geo/nation'")
def served_census(spark, d):
    e = served(spark, d, "hyperedges", "entities")
    return spark.createDataFrame([("order/R", e.census(type="order/R")["count"]), ("geo/nation", e.census(entity_type="geo/nation")["count"])], "type string, n bigint")


@query(f"with {LOG} select id, state from {as_of('log', V, S)}")
def served_asof(spark, d):
    def fill(e: Engine) -> Engine:
        e.store.commit({"docs": adapters.order_log(spark, d).withColumnRenamed("state", "body")})
        return e

    return _once(spark, d, "orders", fill).store.table("docs", datetime.fromisoformat(V), datetime.fromisoformat(S)).select("id", F.col("body").alias("state"))


@query("select 'supp:' || s_suppkey as id, s_name as name from supplier where s_suppkey not in (1, 2, 3, 4)")
def served_retract(spark, d):
    e = _new(spark)
    e.store.append_documents("entities", adapters.entities(spark, d).where("type = 'party/supplier'"))
    e.retract([{"table": "entities", "id": f"supp:{k}"} for k in (1, 2, 3, 4, 4)])
    return e.store.table("entities").select("id", "name")


@query("""select * from (values ('2020-06-01', 'first'), ('2021-06-01', 'second'), ('2022-06-01', null)) t(day, repo)""")
def served_valid_time(spark, d):
    """An edge dated by its payload, dated again, then retracted by its type and endpoints."""
    e = _new(spark)
    edge = {"hx/type": "test/edge", "hx/endpoints": ["b", "a"]}
    e.hyperedge_upsert(edge | {"hx/props": {"repo": "first"}, "hx/valid-time": "2020-01-01T00:00:00Z"})
    e.hyperedge_upsert(edge | {"hx/props": {"repo": "second"}, "hx/valid-time": "2021-01-01T00:00:00Z"})
    e.hyperedge_upsert(edge | {"op": "retract", "hx/valid-time": "2022-01-01T00:00:00Z"})
    out = spark.createDataFrame([(day,) for day in ("2020-06-01", "2021-06-01", "2022-06-01")], "day string")
    held = None
    for day in ("2020-06-01", "2021-06-01", "2022-06-01"):
        then = e.store.table("hyperedges", datetime.fromisoformat(f"{day}T00:00:00+00:00")).where("id = 'hx:test/edge:a.b'").select(F.lit(day).alias("day"), "repo")
        held = then if held is None else held.union(then)
    return out.join(held, "day", "left")


@query("select doc_id::varchar as id, 'erased' as state from documents where doc_id % 2 = 0 and false union all select doc_id::varchar, 'held' from documents where doc_id % 2 = 1 and doc_id < 40")
def served_erase(spark, d):
    e = _new(spark)
    docs = read(spark, d, "documents").where("doc_id < 40").select(F.col("doc_id").cast("string").alias("id"), F.lit("doc").alias("type"), F.lit("2020-01-01").alias("at"), F.col("text").alias("body"))
    e.store.append_documents("evidence", docs)
    e.text_catch_up()
    e.store.erase("evidence", docs.where("cast(id as bigint) % 2 = 0").select("id"))
    left = e.store.log("evidence").select("id").union(e.store.log("text-docs").select("id")).union(e.store.log("postings").select("id"))
    return left.distinct().select("id", F.lit("held").alias("state"))


@query("""with m as (select 'hx:' || n_nationkey as id, 'n-' || n_nationkey as entry, 'pattern/' || n_regionkey as endpoint, n_name as author from nation),
  r as (select endpoint, id, author from m where id not in ('hx:3', 'hx:4') union all select 'pattern/9', 'hx:4', (select author from m where id = 'hx:4'))
  select endpoint, id, author from (select *, row_number() over (partition by endpoint order by id) as k from r) where k <= 10 and endpoint in ('pattern/0', 'pattern/1', 'pattern/9')""")
def served_projection(spark, d):
    """The projection is kept; an edge is then moved and another retracted, and both show without building it again."""
    e = _new(spark)
    n = read(spark, d, "nation")
    entry = F.concat(F.lit("n-"), "n_nationkey")
    facts = n.select(entry.alias("id"), F.lit("memory").alias("type"), F.col("n_name").alias("author"), F.lit("2020-01-01").alias("at"), F.lit("{}").alias("body"))
    edges = n.select(F.concat(F.lit("hx:"), "n_nationkey").alias("id"), F.lit("memory/assert").alias("type"), F.array(entry, F.concat(F.lit("pattern/"), "n_regionkey")).alias("endpoints"), entry.alias("entry"))
    e.store.commit({"evidence": e.store.puts("evidence", facts), "hyperedges": e.store.puts("hyperedges", edges)})
    e.memory_refresh()
    e.hyperedge_upsert({"hx/id": "hx:4", "hx/type": "memory/assert", "hx/endpoints": ["n-4", "pattern/9"], "hx/props": {"roles": {"entry": "n-4"}}})
    e.retract([{"table": "hyperedges", "id": "hx:3"}])
    return e.memory_projection(["pattern/0", "pattern/1", "pattern/9"], 10).where("id is not null").select("endpoint", "id", "author")


@query("select 'Q1' as id, 'queue' as disposition union all select '9x', 'reject'")
def served_gate_queue(spark, d):
    e = _new(spark, models={"gadget": {"id_pattern": "^[a-z]", "queue": ["^Q"]}})
    e.entity_ensure({"id": "Q1", "name": "late", "type": "gadget"})
    try:
        e.entity_ensure({"id": "9x", "name": "bad", "type": "gadget"})
    except Exception as x:  # noqa: BLE001
        if getattr(x, "reason", None) != "non-canonical-id":
            raise
    again = Engine(e.store)
    return spark.createDataFrame([(q["id"], q["disposition"]) for q in again.queue], "id string, disposition string")


@query("select 'gadget' as type, 'entity' as kind, null::varchar as parent union all select 'kit/uses', 'relation', 'kit' union all select 'kit', 'relation', null")
def served_types(spark, d):
    e = _new(spark)
    for i in ("a", "b"):
        e.entity_ensure({"id": i, "name": i, "type": "gadget"})
    e.relations_batch([{"type": "kit/uses", "src": "a", "dst": "b"}])
    return e.types().select("type", "kind", "parent")
