"""The fixtures' document model in DuckDB SQL, for the counterparts of registered queries."""

EV = """ev as (select *, case when k % 7 = 0 then true when k % 7 = 1 then false end as ephemeral,
  [event_type, 'ns/k' || (k % 3)] as tags, [event_type, 'k' || (k % 3)] as tag_names from (
  select 'e-' || event_id as id, event_id, ts, user_id, event_type, event_type as type, case when k % 2 = 0 then 'observation' else 'step' end as claim_type,
    'user-' || user_id as author, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at, 'user-' || user_id || '/' || strftime(ts, '%Y-%m-%d') as session_id,
    lag('e-' || event_id) over (partition by user_id, strftime(ts, '%Y-%m-%d') order by ts, event_id) as in_reply_to,
    case when k % 11 = 0 then 'e-' || (event_id - 1) end as fork_of, props as body, 't' || (k % 5) as ref_id, 'agent/p' || (k % 4) as pattern_id, k
  from (select *, (props->>'$.k')::int as k from events)))"""

HX = """hx as (select 'hx:' || type || ':' || array_to_string(list_sort(endpoints), '.') as id, * from (
  select 'order/' || l_returnflag as type, ['order:' || l_orderkey, 'part:' || l_partkey, 'supp:' || l_suppkey] as endpoints, l_linestatus as repo,
    'f' || l_linenumber || '.clj' as source_file, strftime(l_shipdate, '%Y-%m-%d') as ts, l_orderkey, l_partkey, l_suppkey from lineitem))"""

ENT = """ent as (select 'part:' || p_partkey as id, p_name as name, 'item/' || lower(p_type) as type, 'item' as source, p_partkey::varchar as external_id from part
  union all select 'cust:' || c_custkey, c_name, 'party/' || lower(c_mktsegment), 'party', c_custkey::varchar from customer
  union all select 'supp:' || s_suppkey, s_name, 'party/supplier', 'party', s_suppkey::varchar from supplier
  union all select 'nation:' || n_nationkey, n_name, 'geo/nation', 'geo', n_nationkey::varchar from nation
  union all select 'region:' || r_regionkey, r_name, 'geo/region', 'geo', r_regionkey::varchar from region)"""

REL = """rel as (select 'rel|' || src || '|' || type || '|' || dst || '||' as id, * from (
  select 'geo/in-region' as type, 'nation:' || n_nationkey as src, 'region:' || n_regionkey as dst from nation
  union all select 'geo/in-nation', 'cust:' || c_custkey, 'nation:' || c_nationkey from customer
  union all select 'geo/in-nation', 'supp:' || s_suppkey, 'nation:' || s_nationkey from supplier
  union all select 'order/placed-by', 'order:' || o_orderkey, 'cust:' || o_custkey from orders))"""

LOG = """log as (select 'o:' || o_orderkey as id, 'put' as op, o_orderdate as valid_from, null::timestamp as valid_to, o_orderdate as system_time, 4 * o_orderkey as ordinal, 'open' as state from orders
  union all select 'o:' || o_orderkey, 'put', o_orderdate + interval 10 day, null, o_orderdate + interval 12 day, 4 * o_orderkey + 1, o_orderstatus from orders
  union all select 'o:' || o_orderkey, 'delete', o_orderdate + interval 30 day, null, o_orderdate + interval 30 day, 4 * o_orderkey + 2, null from orders where o_orderstatus = 'F'
  union all select 'o:' || o_orderkey, 'put', o_orderdate - interval 5 day, o_orderdate, o_orderdate + interval 40 day, 4 * o_orderkey + 3, 'quote' from orders where o_orderkey % 10 = 0)"""

MEM = """mem as (select 'hx:memory-' || event_id as id, ['e-' || event_id, 'pattern/' || (k % 4), 'user-' || user_id] as endpoints,
    case when k % 9 = 0 then null when k % 13 = 0 then 'e-missing' else 'e-' || event_id end as entry, ts, k, 'e-' || event_id as own
  from (select *, (props->>'$.k')::int as k from events))"""

TOK = "tok as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: len(x) >= 2)) as token from documents)"
POST = TOK + ", post as (select doc_id, token, count(*) as tf from tok group by all)"


def as_of(log: str, valid: str, system: str | None = None) -> str:
    """The rows of ``log`` that hold."""
    seen = f"system_time <= timestamp '{system}' and " if system else ""
    return f"""(select * from (select *, row_number() over (partition by id order by system_time desc, ordinal desc) as w from {log}
      where {seen}valid_from <= timestamp '{valid}' and (valid_to is null or timestamp '{valid}' < valid_to)) where w = 1 and op = 'put')"""
