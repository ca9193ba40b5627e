"""Queries over hyperedges, entities and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources.adapters import entities, evidence, hyperedges, relations
from .models import ENT, EV, HX, REL
from .registry import query

FLAT = "id, type, array_to_string(endpoints, ',') as endpoints, repo, source_file, ts as timestamp"


def flat(rows):
    return rows.select("id", "type", F.array_join("endpoints", ",").alias("endpoints"), "repo", "source_file", "timestamp")


@query(f"with {HX} select {FLAT} from hx where type = 'order/A'")
def hx_by_type(spark, d):
    return flat(g.by_type(hyperedges(spark, d), ":order/A"))


@query(f"with {HX} select {FLAT} from hx where type = 'order/R' order by id limit 100")
def hx_by_type_limit(spark, d):
    return flat(g.window(g.by_type(hyperedges(spark, d), "order/R"), 100))


@query(f"with {HX} select {FLAT} from hx where type = 'order/N' and repo = 'O'")
def hx_type_repo(spark, d):
    return flat(g.by_type(hyperedges(spark, d), "order/N", repo="O"))


@query(f"with {HX} select {FLAT} from hx where type = 'order/N' and source_file = 'f3.clj'")
def hx_type_source_file(spark, d):
    return flat(g.by_type(hyperedges(spark, d), "order/N", source_file="f3.clj"))


@query(f"with {HX} select {FLAT} from hx where type = 'order/A' order by ts desc nulls last, id desc limit 1")
def hx_latest(spark, d):
    return flat(g.window(g.by_type(hyperedges(spark, d), "order/A"), latest=True))


@query(f"with {HX} select count(*)::bigint as count, least(count(*), 100)::bigint as returned from hx where type = 'order/R'")
def hx_true_total(spark, d):
    rows = g.by_type(hyperedges(spark, d), "order/R")
    return rows.agg(F.count("*").alias("count")).crossJoin(rows.limit(100).agg(F.count("*").alias("returned")))


@query(f"with {HX} select {FLAT} from hx where list_contains(endpoints, 'part:7')")
def hx_end(spark, d):
    return flat(g.with_endpoint(hyperedges(spark, d), "part:7"))


@query(f"with {HX} select {FLAT} from hx where list_has_any(endpoints, ['supp:3', 'part:7']) and type = 'order/N'")
def hx_end_type(spark, d):
    return flat(g.with_endpoint(hyperedges(spark, d), "supp:3", "part:7", type="order/N"))


@query(f"with {HX} select count(distinct e)::bigint as endpoints from (select unnest(endpoints) as e from hx)")
def hx_distinct_endpoints(spark, d):
    return g.exploded(hyperedges(spark, d)).agg(F.countDistinct("endpoint").alias("endpoints"))


@query(f"with {HX} select e as endpoint, count(*)::bigint as count from (select unnest(endpoints) as e from hx) group by e")
def hx_endpoint_freq(spark, d):
    return g.endpoint_counts(hyperedges(spark, d))


@query(f"with {HX} select e as endpoint, count(*)::bigint as count from (select unnest(endpoints) as e from hx) group by e order by count desc, endpoint limit 1")
def hx_top_endpoint(spark, d):
    return g.endpoint_counts(hyperedges(spark, d)).orderBy(F.desc("count"), "endpoint").limit(1)


@query(f"with {HX} select distinct e as endpoint from (select unnest(endpoints) as e from hx where list_contains(endpoints, 'supp:5')) where e <> 'supp:5'")
def hx_ego_network(spark, d):
    return g.ego(hyperedges(spark, d), "supp:5")


@query(f"with {HX} select type, count(*)::bigint as count from hx group by type")
def hx_type_census(spark, d):
    return g.census(hyperedges(spark, d))


@query(f"with {HX} select repo, count(*)::bigint as count from hx where type = 'order/A' group by repo")
def hx_census_by_repo(spark, d):
    return g.census(g.by_type(hyperedges(spark, d), "order/A"), "repo")


@query(f"with {HX} select id, count(*)::bigint as count from hx group by id")
def hx_stable_id(spark, d):
    return g.census(hyperedges(spark, d), "id")


@query(f"with {ENT} select * from ent where type = 'party/supplier'")
def ent_by_type(spark, d):
    return g.entities_of(entities(spark, d), "party/supplier")


@query(f"with {ENT} select arg_min(id, id) as id, name, any_value(type) as type, any_value(source) as source, arg_min(external_id, id) as external_id from ent where type = 'item/economy' group by name")
def ent_latest_by_name(spark, d):
    return g.latest_by_name(entities(spark, d), "item/economy")


FETCH = """with {ent}, k as (select unnest(['part:3', 'NATION_3', '4', 'nobody']) as key),
  m as (select key, ent.*, case when id = key then 1 when name = key then 2 else 3 end as leg from k join ent on id = key or name = key or external_id = key)
  select key, id, name from (select *, row_number() over (partition by key order by leg, id) as r from m) where r = 1""".replace("{ent}", ENT)


@query(FETCH)
def ent_fetch_fallback(spark, d):
    every = entities(spark, d)
    out = None
    for key in ("part:3", "NATION_3", "4", "nobody"):
        one = g.fetch_entity(every, key).select(F.lit(key).alias("key"), "id", "name")
        out = one if out is None else out.union(one)
    return out


@query(f"with {ENT} select source, external_id, string_agg(id, ',' order by id) as candidates from ent group by source, external_id having count(*) > 1")
def ent_external_ambiguous(spark, d):
    return g.ambiguous_externals(entities(spark, d)).withColumn("candidates", F.array_join("candidates", ","))


@query(f'with {REL} select id, type, src, dst, src as "from", dst as "to" from rel where type = \'geo/in-nation\'')
def rel_typed(spark, d):
    return g.relations_of(relations(spark, d), type="geo/in-nation")


@query(f'with {REL} select id, type, src, dst, src as "from", dst as "to" from rel where dst = \'nation:3\' and type in (\'geo/in-nation\', \'geo/in-region\')')
def rel_from_to(spark, d):
    return g.relations_of(relations(spark, d), types=["geo/in-nation", "geo/in-region", "geo/in-nation"], dst="nation:3")


@query(f"with {REL}, {ENT} select * from ent where id in (select src from rel where type = 'order/placed-by' union select dst from rel where type = 'order/placed-by')")
def rel_hydrate_semi(spark, d):
    return g.hydrate(g.relations_of(relations(spark, d), type="order/placed-by"), entities(spark, d))


@query(f"with {REL}, {ENT} select id, e as endpoint from (select id, unnest([src, dst]) as e from rel) where e not in (select id from ent)")
def rel_missing_endpoint_anti(spark, d):
    return g.missing_ends(relations(spark, d), entities(spark, d))


@query(f"with {REL} select id, count(*)::bigint as count from rel group by id")
def rel_stable_id(spark, d):
    return g.census(relations(spark, d), "id")


RESOLVE = """with {ent}, w as (select unnest(['part:3', 'NATION_3', 'red widget', '123e4567-e89b-12d3-a456-426614174000', 'nobody']) as key)
  select key, coalesce((select id from ent where id = key), (select min(id) from ent where name = key), case when regexp_full_match(key, '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}') then key end) as resolved from w""".replace("{ent}", ENT)


@query(RESOLVE)
def rel_resolve_ends(spark, d):
    wanted = spark.createDataFrame([("part:3",), ("NATION_3",), ("red widget",), ("123e4567-e89b-12d3-a456-426614174000",), ("nobody",)], "key string")
    return g.resolve_ends(wanted, entities(spark, d))


@query(f"with {HX}, {ENT}, p as (select hx.id, list(distinct ent.type) as found from (select id, unnest(endpoints) as e from hx where type = 'order/A') hx join ent on ent.id = e group by hx.id) "
       "select * from (values (0, 'entity', exists (select 1 from ent where type = 'geo/nation')), (1, 'hyperedge', exists (select 1 from p where list_has_all(found, ['party/supplier', 'item/economy']))), "
       "(2, 'hyperedge', exists (select 1 from p where list_has_all(found, ['geo/region']))), (3, 'hyperedge', exists (select 1 from hx where type = 'order/N')), (4, 'other', false)) t(n, kind, inhabited)")
def graph_inhabited(spark, d):
    asked = [
        {"kind": "entity", "type": ":geo/nation"}, {"kind": "hyperedge", "type": "order/A", "endpoint_types": ["party/supplier", "item/economy"]},
        {"kind": "hyperedge", "type": "order/A", "endpoint_types": ["geo/region"]}, {"kind": "hyperedge", "type": "order/N", "endpoint_types": []}, {"kind": "other", "type": "x"},
    ]
    return g.inhabited(asked, entities(spark, d), hyperedges(spark, d))


TYPES = """with {ent}, {rel}, t as (select distinct 'entity' as kind, type as id from ent union select distinct 'relation', type from rel),
  p as (select kind, id, nullif(regexp_extract(id, '^([^/]+)/.+', 1), '') as parent from t)
  select kind, id, max(parent) as parent from (select * from p union all select kind, parent, null from p where parent is not null) group by kind, id""".replace("{ent}", ENT).replace("{rel}", REL)


@query(TYPES)
def type_registry_parents(spark, d):
    return g.type_registry((entities(spark, d), "type", "entity"), (relations(spark, d), "type", "relation"))


@query(f"with {EV}, {HX}, {ENT}, {REL} select 'evidence' as \"table\", count(*)::bigint as count from ev union all select 'hyperedges', count(*) from hx union all select 'entities', count(*) from ent union all select 'relations', count(*) from rel")
def table_census(spark, d):
    out = None
    for name, rows in {"evidence": evidence, "hyperedges": hyperedges, "entities": entities, "relations": relations}.items():
        one = rows(spark, d).agg(F.count("*").alias("count")).select(F.lit(name).alias("table"), "count")
        out = one if out is None else out.union(one)
    return out
