"""Bitemporal reads, and memory projections on both bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as mem
from ..operators import temporal as t
from ..sources.adapters import evidence, memory_edges, memory_log, order_log
from .models import EV, LOG, MEM, as_of
from .registry import query

V, S = "1998-06-01 00:00:00", "1998-06-05 00:00:00"


def shown(rows):
    return rows.select("id", "state")


@query(f"with {LOG} select id, state from {as_of('log', V)}")
def asof_valid(spark, d):
    return shown(t.as_of(order_log(spark, d), valid=V))


@query(f"with {LOG} select id, state from {as_of('log', '2005-01-01 00:00:00', S)}")
def asof_system(spark, d):
    return shown(t.as_of(order_log(spark, d), valid="2005-01-01 00:00:00", system=S))


@query(f"with {LOG} select id, state from {as_of('log', V, S)}")
def asof_both(spark, d):
    return shown(t.as_of(order_log(spark, d), valid=V, system=S))


@query(f"with {LOG} select id, state from {as_of('log', '2026-01-01 00:00:00')}")
def current_view(spark, d):
    return shown(t.current(order_log(spark, d)))


@query(f"with {LOG} select distinct id from log where op = 'delete' and id not in (select id from {as_of('log', '2026-01-01 00:00:00')})")
def asof_retracted(spark, d):
    log = order_log(spark, d)
    return log.where("op = 'delete'").select("id").distinct().join(t.current(log).select("id"), "id", "left_anti")


@query(f"with {LOG} select id, count(*)::bigint as versions, sum((op = 'delete')::int)::bigint as deletes from log where id not in (select 'o:' || o_orderkey from orders where o_orderkey % 7 = 0) group by id")
def log_erase(spark, d):
    log = order_log(spark, d)
    gone = log.select("id").distinct().where(F.substring("id", 3, 30).cast("bigint") % 7 == 0)
    return t.erase(log, gone).groupBy("id").agg(F.count("*").alias("versions"), F.sum((F.col("op") == "delete").cast("int")).alias("deletes"))


ENDS = ["pattern/1", "user-3", "absent", "pattern/1"]
ASKED = "asked as (select * from (values (0, 'pattern/1'), (1, 'user-3'), (2, 'absent')) t(n, endpoint))"
COMP = f"{EV}, {MEM}, {ASKED}, comp as (select mem.id, mem.endpoints, ev.id as entry_id, ev.type as entry_type, ev.author from mem join ev on ev.id = mem.entry)"
FIRST = """first as (select * from (select *, row_number() over (partition by endpoint order by id) as nth from
  (select *, unnest(endpoints) as endpoint from {}) where endpoint in (select endpoint from asked)) where nth <= {})"""
OUT = "select asked.n, asked.endpoint, first.id as id, entry_id, entry_type, author, coalesce(nth, 0)::int as nth from asked left join first using (endpoint)"


def flat(rows):
    return rows.select("n", "endpoint", "id", "entry_id", "entry_type", "author", F.coalesce(F.col("nth"), F.lit(0)).cast("int").alias("nth"))


@query(f"with {COMP}, {FIRST.format('comp', 10)} {OUT}")
def mem_projection_current(spark, d):
    return flat(mem.project(mem.components(memory_edges(spark, d), evidence(spark, d)), ENDS, 10))


AUDIT = "select n, endpoint, count(id)::bigint as selected, count(entry_id)::bigint as components, sum((id is not null and entry_id is null)::int)::bigint as missing, (select count(distinct id) from o)::bigint as edges, (select count(distinct entry_id) from o)::bigint as entries from o group by n, endpoint"


@query(f"with {COMP}, {FIRST.format('comp', 10)}, o as ({OUT}) {AUDIT}")
def mem_projection_audit(spark, d):
    return mem.audit(mem.project(mem.components(memory_edges(spark, d), evidence(spark, d)), ENDS, 10))


AT, BY = "2024-01-01 01:30:00", "2024-01-01 02:00:00"
MLOG = """mlog as (select id, 'put' as op, ts as valid_from, null::timestamp as valid_to, ts as system_time, 0 as ordinal, endpoints, entry from mem
  union all select id, 'delete', ts + interval 5 day, null, ts + interval 5 day, 1, endpoints, entry from mem where k % 6 = 0)"""


HELD = f"{EV}, {MEM}, {MLOG}, {ASKED}, held as {as_of('mlog', AT, BY)}, comp as (select held.id, held.endpoints, ev.id as entry_id, ev.type as entry_type, ev.author from held left join ev on ev.id = held.entry), {FIRST.format('comp', 100)}"


def _then(spark, d):
    return mem.project_as_of(t.as_of(memory_log(spark, d), valid=AT, system=BY), evidence(spark, d), ENDS, 100)


@query(f"with {HELD} {OUT}")
def mem_projection_asof(spark, d):
    return flat(_then(spark, d))


@query(f"with {HELD}, o as ({OUT}) {AUDIT}")
def mem_projection_asof_audit(spark, d):
    return mem.audit(_then(spark, d))


@query(f"with {EV} select id, type, author, at from ev where type = 'click' and list_has_any(tags, ['ns/k1', 'ns/k2']) and at >= '2024-01-03' order by at desc, id desc limit 20")
def mem_search_structured(spark, d):
    return mem.search(evidence(spark, d), type="click", tags=["ns/k1", "ns/k2"], since="2024-01-03").select("id", "type", "author", "at")
