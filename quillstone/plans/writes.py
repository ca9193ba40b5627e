"""Gates, guards, verification and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import names
from ..operators import graph, ingest, text, verify
from ..sources.adapters import entities, evidence, hyperedges, read, relations
from .models import ENT, EV, HX, REL
from .registry import query


@query(f"with {ENT} select source, case when regexp_matches(id, '^part:[0-9]+$') then 'accept' when regexp_matches(id, '^cust:') then 'queue' else 'reject' end as disposition, count(*)::bigint as count from ent group by all")
def ingest_gate_classify(spark, d):
    rows = entities(spark, d).withColumn("disposition", ingest.classify_id(F.col("id"), "^part:[0-9]+$", ["^cust:"]))
    return graph.census(rows, "source", "disposition")


BATCH = """with {ev}, store as (select * from ev where event_id % 4 <> 0), batch as (select *, event_id as nth from ev where event_id % 3 = 0 union all select *, event_id + 1000000000 from ev where event_id % 30 = 0),
  known as (select id from store union select id from batch),
  j as (select *, row_number() over (partition by id order by nth) > 1 as again from batch)
  select id, nth::bigint as nth, case when reason = 'created' then 201 else 409 end as status, reason from (select id, nth,
    case when in_reply_to is not null and in_reply_to not in (select id from known) then 'reply-not-found' when fork_of is not null and fork_of not in (select id from known) then 'fork-not-found'
         when id in (select id from store) or again then 'duplicate-id' else 'created' end as reason from j)""".replace("{ev}", EV)


@query(BATCH)
def ingest_duplicate_guard(spark, d):
    number = F.substring("id", 3, 20).cast("bigint")
    rows = evidence(spark, d).withColumn("nth", number)
    batch = rows.where("nth % 3 = 0").union(rows.where("nth % 30 = 0").withColumn("nth", F.col("nth") + 1000000000))
    return ingest.append_guard(batch, rows.where("nth % 4 <> 0")).select("id", "nth", "status", "reason")


@query(f"with {HX} select id, count(*)::bigint as n, (l_partkey % 5 <> 0 and l_partkey % 8 <> 0)::varchar as no_op from hx group by id, l_partkey")
def ingest_noop_guard(spark, d):
    """Posted again: one part in five with another file, one in eight unknown to the store, every third without a repo."""
    same = Window.partitionBy("id").orderBy("timestamp", "source_file", "repo")
    part = F.regexp_extract("id", r"part:(\d+)", 1).cast("bigint")
    # both sides of the guard read one shuffle by id, whose order is kept; the number of equal ids goes along
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = hyperedges(spark, d).where("id is not null").select("*", F.count("*").over(whole).alias("n"), F.row_number().over(same).alias("nth"))
    kept = F.when(part % 8 != 0, F.col("nth")) == 1
    new = rows.where(kept | (part % 8 == 0)).withColumn("repo", F.when(part % 3 != 0, F.col("repo"))).withColumn("source_file", F.when(part % 5 == 0, "new.clj").otherwise(F.col("source_file")))
    done = ingest.noop_guard(new, rows.where(kept), ["type", "repo", "source_file", "timestamp"])
    return done.groupBy("id").agg(F.max("n").alias("n"), F.min("no_op").cast("string").alias("no_op"))


@query(f"with {EV} select id from ev where event_id % 25 = 0")
def ingest_read_back(spark, d):
    rows = evidence(spark, d).select("id")
    return ingest.read_back(rows, rows.where(F.substring("id", 3, 20).cast("bigint") % 25 != 0))


@query(f"with {ENT}, t as (select distinct type as id from ent) select 'entity' as kind, id, nullif(regexp_extract(id, '^([^/]+)/.+', 1), '') as parent from t where id not like 'geo/%' union all select 'entity', 'item', null union all select 'entity', 'party', null")
def ingest_new_types(spark, d):
    found = graph.type_registry((entities(spark, d), "type", "entity"))
    return ingest.new_types(found, found.where("id like 'geo%'").select("kind", "id"))


@query(f"with {EV} select distinct t as tag, regexp_replace(t, '^[^/]+/', '') as name, nullif(regexp_extract(t, '^([^/]+)/.+', 1), '') as space from (select unnest(tags) as t from ev)")
def tag_normalise(spark, d):
    tags = evidence(spark, d).select(F.explode("tags").alias("tag")).distinct()
    return tags.select("tag", names.name_col(F.col("tag")).alias("name"), names.namespace_col(F.col("tag")).alias("space"))


@query(f"with {EV}, {HX}, {REL} select \"table\", source, coalesce(target, -1)::bigint as target, status from (values ('evidence', (select count(*) from ev), (select count(*) from ev where event_id % 9 <> 0)), ('hyperedges', (select count(*) from hx), (select count(*) from hx)), ('relations', (select count(*) from rel), null)) t(\"table\", source, target), "
       "lateral (select case when source is null or target is null then 'skip' when source = target then 'pass' else 'fail' end as status)")
def verify_counts(spark, d):
    ev, hx = evidence(spark, d), hyperedges(spark, d)
    return verify.population({"evidence": ev, "hyperedges": hx, "relations": relations(spark, d)}, {"evidence": ev.where(F.substring("id", 3, 20).cast("bigint") % 9 != 0), "hyperedges": hx}).withColumn("target", F.coalesce("target", F.lit(-1)))


@query(f"with {EV} select id, md5(array_to_string(list_filter(['at=' || at, 'author=' || author, 'in_reply_to=' || in_reply_to, 'pattern_id=' || pattern_id, 'type=' || type], lambda x: x is not null), chr(10))) as checksum from ev")
def verify_doc_checksum(spark, d):
    return evidence(spark, d).select("id", verify.row_checksum(["type", "author", "at", "in_reply_to", "pattern_id"]).alias("checksum"))


@query(f"with {EV} select id, case when event_id % 41 = 0 then 'missing' when k % 50 = 0 then 'different' else 'same' end as status, case when event_id % 41 <> 0 and k % 50 = 0 then 'author,pattern_id' else '' end as keys from ev union all select 'x-' || event_id, 'extra', '' from ev where event_id % 100 = 0")
def verify_parity(spark, d):
    rows = evidence(spark, d).select("id", "author", "at", "fork_of", "pattern_id", "body")
    n, k = F.substring("id", 3, 20).cast("bigint"), F.get_json_object("body", "$.k").cast("int")
    moved = rows.where(n % 41 != 0).withColumn("author", F.when(k % 50 == 0, "other").otherwise(F.col("author"))).withColumn("pattern_id", F.when(k % 50 != 0, F.col("pattern_id"))).withColumn("fork_of", F.coalesce("fork_of", F.lit("more")))
    extra = rows.where(n % 100 == 0).withColumn("id", F.concat(F.lit("x-"), n))
    return verify.compare(rows, moved.unionByName(extra), "id", ["author", "at", "fork_of", "pattern_id"])


@query(f"with {EV}, v as (select type, count(*) as a, sum((event_id % 13 <> 0)::int) as b from ev group by type) select type, a::bigint as source, b::bigint as target, (a = b)::varchar as same from v")
def verify_census_parity(spark, d):
    rows = evidence(spark, d)
    other = graph.census(rows.where(F.substring("id", 3, 20).cast("bigint") % 13 != 0)).toDF("type", "target")
    return graph.census(rows).toDF("type", "source").join(other, "type", "full_outer").select("type", "source", "target", (F.col("source") == F.col("target")).cast("string").alias("same"))


STREAM = """with d as (select event_id, string_split_regex(lower(event_type || ' ' || props), '[^a-z0-9]+') as toks from events)
  select 'e-' || event_id as id, t as token, count(*)::bigint as tf from (select event_id, unnest(list_filter(toks, lambda x: len(x) >= 2)) as t from d) group by all"""


@query(STREAM)
def stream_append_postings(spark, d):
    from ..streaming.incremental import replay_postings

    rows = read(spark, d, "events").select(F.concat(F.lit("e-"), "event_id").alias("id"), F.concat_ws(" ", "event_type", "props").alias("text"))
    return replay_postings(rows, batches=3)


@query("with e as (select 'user-' || user_id as endpoint, 'hx:memory-' || event_id as id from events) select endpoint, count(*)::bigint as components, min(id) as first_id from e group by endpoint")
def stream_projection(spark, d):
    from ..streaming.incremental import replay_projection
    from ..sources.adapters import memory_edges

    rows = replay_projection(memory_edges(spark, d).select("id", F.explode("endpoints").alias("endpoint")), batches=3)
    return rows.where("endpoint like 'user-%'").groupBy("endpoint").agg(F.count("*").alias("components"), F.min("id").alias("first_id"))


@query(f"""with {EV} select id, md5('{{"id":"' || id || '","subject":{{"ref_id":"' || ref_id || '","ref_type":"thread"}},"tags":["' || tags[1] || '","' || tags[2] || '"]}}') as checksum from ev where type = 'view'""")
def verify_nested_checksum(spark, d):
    rows = evidence(spark, d).where("type = 'view'")
    return rows.select("id", verify.document_checksum(rows, ["tags", "subject", "id"]).alias("checksum"))
