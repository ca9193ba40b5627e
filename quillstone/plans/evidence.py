"""Queries over the evidence log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources.adapters import evidence
from .models import EV
from .registry import query

FLAT = ("id", "type", "author", "at", "session_id", "body")
COLS = "id, type, author, at, session_id, body"
NEWEST = "order by at desc, id desc"


def page(where: str, limit: int, order: str = NEWEST) -> str:
    return f"with {EV} select {COLS} from ev where {where} {order} limit {limit}"


@query(page("type = 'click' and at >= '2024-01-05' and at < '2024-01-20T12:00:00.000000Z'", 100))
def ev_page_newest(spark, d):
    return ev.newest(ev.select(evidence(spark, d), type="click", since="2024-01-05", before="2024-01-20T12:00:00.000000Z"), 100).select(*FLAT)


@query(page("at < '2024-01-15' or (at = '2024-01-15' and id < 'e-5')", 100))
def ev_page_cursor(spark, d):
    return ev.newest(evidence(spark, d).where(ev.after_cursor("2024-01-15", "e-5")), 100).select(*FLAT)


@query(page("at > '2024-01-15' or (at = '2024-01-15' and id > 'e-5')", 100, "order by at, id"))
def ev_page_oldest(spark, d):
    return ev.oldest(evidence(spark, d).where(ev.before_cursor("2024-01-15", "e-5")), 100).select(*FLAT)


@query(f"with {EV} select {COLS} from ev where at >= '2024-01-10' and at < '2024-01-12'")
def ev_since_before(spark, d):
    return ev.select(evidence(spark, d), since="2024-01-10", before="2024-01-12").select(*FLAT)


@query(f"with {EV} select {COLS} from ev where type = 'purchase' and author = 'user-7'")
def ev_type_author(spark, d):
    return ev.select(evidence(spark, d), type=":purchase", author="user-7").select(*FLAT)


@query(f"with {EV} select {COLS} from ev where claim_type = 'step' and type = 'view'")
def ev_claim_type(spark, d):
    return ev.select(evidence(spark, d), claim_type="step", type="view").select(*FLAT)


@query(page("session_id = 'user-7/2024-01-03'", 100))
def ev_session_page(spark, d):
    return ev.newest(ev.select(evidence(spark, d), session_id="user-7/2024-01-03"), 100).select(*FLAT)


@query(f"with {EV} select {COLS}, fork_of from ev where fork_of = 'e-41' or fork_of is not null and type = 'error'")
def ev_forks(spark, d):
    rows = evidence(spark, d)
    return rows.where((F.col("fork_of") == "e-41") | (F.col("fork_of").isNotNull() & (F.col("type") == "error"))).select(*FLAT, "fork_of")


@query(f"with {EV} select {COLS} from ev where list_has_all(tag_names, ['click', 'k1'])")
def ev_tags_all_names(spark, d):
    return ev.select(evidence(spark, d), tags=["click", "k1"]).select(*FLAT)


@query(f"with {EV} select {COLS} from ev where list_has_any(tags, ['ns/k2', 'signup'])")
def ev_tags_any(spark, d):
    return ev.select(evidence(spark, d), tags_exact=["ns/k2", "signup"]).select(*FLAT)


@query(f"with {EV} select {COLS} from ev where ref_id = 't1'")
def ev_subject(spark, d):
    return ev.select(evidence(spark, d), subject_type="thread", subject_id="t1").select(*FLAT)


@query(f"with {EV} select {COLS} from ev where pattern_id = 'agent/p2'")
def ev_pattern(spark, d):
    return ev.select(evidence(spark, d), pattern_id="agent/p2").select(*FLAT)


@query(f"with {EV} select {COLS}, ephemeral::varchar as ephemeral from ev where not coalesce(ephemeral, false)")
def ev_not_ephemeral(spark, d):
    return ev.select(evidence(spark, d), include_ephemeral=False).select(*FLAT, F.col("ephemeral").cast("string").alias("ephemeral"))


@query(f"with {EV} select count(*)::bigint as count from ev where type = 'error' and at >= '2024-01-10'")
def ev_count(spark, d):
    return ev.count(evidence(spark, d), type="error", since="2024-01-10")


SESSIONS = """select session_id, count(*)::bigint as count, array_to_string(list_sort(list(distinct ':' || type)), ',') as types,
  array_to_string(list_sort(list(distinct author)), ',') as authors, min(at) as earliest_at, max(at) as latest_at from ev where {} group by session_id"""


def _joined(rows):
    return rows.withColumn("types", F.array_join("types", ",")).withColumn("authors", F.array_join("authors", ","))


@query(f"with {EV} {SESSIONS.format('session_id is not null')}")
def ev_sessions(spark, d):
    return _joined(ev.sessions(evidence(spark, d)))


@query(f"with {EV} select * from ({SESSIONS.format(chr(39) + 'user-11' + chr(39) + ' = author')}) order by latest_at desc, session_id desc limit 100")
def ev_sessions_author(spark, d):
    return _joined(ev.sessions_page(evidence(spark, d), author="user-11")[0])


@query(f"with {EV}, s as ({SESSIONS.format('at >= ' + chr(39) + '2024-01-20' + chr(39))}) select count(*)::bigint as total_sessions, sum(count)::bigint as total_entries from s")
def ev_sessions_totals(spark, d):
    return ev.sessions_page(evidence(spark, d), since="2024-01-20")[1]


CHAIN = """with recursive {ev}, up as (select id, in_reply_to, 0 as n from ev where id = (select max(id) from ev where in_reply_to is not null)
  union all select e.id, e.in_reply_to, up.n + 1 from up join ev e on e.id = up.in_reply_to)
  select e.id, e.type, e.at, ((select max(n) from up) - up.n)::int as depth from up join ev e using (id)""".replace("{ev}", EV)


@query(CHAIN)
def ev_chain(spark, d):
    rows = evidence(spark, d)
    last = rows.where("in_reply_to is not null").agg(F.max("id")).first()[0]
    return ev.chain(rows, last).select("id", "type", "at", "depth")


ROOTS = """with recursive {ev}, up as (select id, id as root, 0 as depth from ev where in_reply_to is null
  union all select e.id, up.root, up.depth + 1 from up join ev e on e.in_reply_to = up.id) select id, root, depth::bigint as depth from up""".replace("{ev}", EV)


@query(ROOTS)
def ev_thread_roots(spark, d):
    return ev.roots(evidence(spark, d))
