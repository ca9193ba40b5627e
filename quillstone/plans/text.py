"""Text search and corpus analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import text as x
from ..sources.adapters import evidence, read
from .models import EV, POST
from .registry import query

TOKS = r"d as (select *, list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: len(t) >= 1) as toks from documents)"


def ids(rows):
    return rows.select("doc_id")


def documents(spark, d):
    return read(spark, d, "documents")


@query(f"with {TOKS} select doc_id from d where list_contains(toks, 'licensed')")
def txt_search_single(spark, d):
    return ids(x.search(documents(spark, d), "licensed", None, "doc_id"))


@query(f"with {TOKS} select doc_id from d where list_has_all(toks, ['apache', 'license', 'the'])")
def txt_search_and(spark, d):
    return ids(x.search(documents(spark, d), "apache license AND the", None, "doc_id"))


@query(f"with {TOKS} select doc_id from d where list_contains(toks, 'gnu') or list_has_all(toks, ['mit', 'license']) or list_contains(toks, 'clown')")
def txt_search_or(spark, d):
    return ids(x.search(documents(spark, d), "GNU OR mit license OR clown", None, "doc_id"))


@query(f"with {TOKS} select doc_id from d where contains(' ' || array_to_string(toks, ' ') || ' ', ' by nc ') or contains(' ' || array_to_string(toks, ' ') || ' ', ' version 2 0 ')")
def txt_search_phrase(spark, d):
    return ids(x.search(documents(spark, d), "by-nc OR version-2.0", None, "doc_id"))


@query(f"with {TOKS} select doc_id from d where list_has_all(toks, ['fur', 'uber']) or list_contains(toks, 'espanol') or contains(' ' || array_to_string(toks, ' ') || ' ', ' el ano ')")
def txt_search_accents(spark, d):
    return ids(x.search(documents(spark, d), "FÜR über OR Español OR el-año", None, "doc_id"))


@query(f"with {TOKS} select doc_id, lang, source from d where list_contains(toks, 'the') and lang = 'en' and source = 'src3'")
def txt_search_filtered(spark, d):
    return x.search(documents(spark, d), "the", None, "doc_id").where("lang = 'en' and source = 'src3'").select("doc_id", "lang", "source")


BM25 = """, n as (select count(*) as n, avg(len(toks)) as avgdl, sum(list_contains(toks, 'idiot')::int) as d0, sum(list_contains(toks, 'clown')::int) as d1 from d),
  s as (select doc_id, len(toks) as dl, len(list_filter(toks, lambda t: t = 'idiot')) as t0, len(list_filter(toks, lambda t: t = 'clown')) as t1 from d),
  r as (select doc_id, -greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) as score from s, n where t0 > 0 or t1 > 0)
  select doc_id, round(score, 6) as score from r order by r.score, doc_id limit 10"""


@query(f"with {TOKS}{BM25}")
def txt_bm25_topk(spark, d):
    return x.search(documents(spark, d), "idiot OR clown", 10, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {TOKS}{BM25.replace(' limit 10', '')}")
def txt_bm25_postings(spark, d):
    docs = documents(spark, d)
    toks = docs.select("doc_id", x.folded_tokens(F.col("text")).alias("toks"))
    posts = x.postings(docs, "doc_id", least=1, tokens=x.folded_tokens)
    return x.search_postings(posts, toks.select("doc_id", F.size("toks").alias("dl")), "idiot OR clown", None, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {TOKS} select doc_id, lang from d where list_has_all(toks, ['is', 'scum']) order by doc_id limit 24")
def mem_search_text(spark, d):
    return x.search(documents(spark, d), "is scum", None, "doc_id").orderBy("doc_id").limit(24).select("doc_id", "lang")


@query(f"with {POST} select doc_id, token, tf::bigint as tf from post")
def corpus_postings(spark, d):
    return x.postings(documents(spark, d), "doc_id")


@query("select 'lang' as path, count(*)::bigint as strings, sum(len(lang))::bigint as chars, max(len(lang))::bigint as max_chars, count(distinct doc_id)::bigint as docs from documents union all "
       "select 'body.text', count(*), sum(len(text))::bigint, max(len(text)), count(distinct doc_id) from documents union all "
       "select 'tags.*', 2 * count(*), sum(len(lang) + len(source))::bigint, max(greatest(len(lang), len(source))), count(distinct doc_id) from documents")
def corpus_field_census(spark, d):
    doc = F.to_json(F.struct("lang", F.struct("text", "n_chars").alias("body"), F.array("lang", "source").alias("tags")))
    return c.field_census(documents(spark, d).select("doc_id", doc.alias("doc")), "doc_id", "doc")


@query("select lang || '/' || source as key, count(*)::bigint as count from documents group by 1")
def corpus_type_histogram(spark, d):
    return c.histogram(documents(spark, d), F.concat_ws("/", "lang", "source"))


SEEN = "seen as (select p_partkey, count(l_partkey) as n from part left join lineitem on p_partkey = l_partkey group by 1), s as (select p_partkey, case when n = 0 then null else n end as seen from seen)"


def _seen(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("seen"))
    return read(spark, d, "part").select("p_partkey").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "seen")


@query(f"with {SEEN} select coalesce(seen, 1)::bigint as seen, count(*)::bigint as count from s group by 1")
def corpus_seen_histogram(spark, d):
    return c.histogram(_seen(spark, d), F.coalesce("seen", F.lit(1)), "seen")


@query(f"with {SEEN} select count(*)::bigint as total, sum(coalesce(seen, 1) - 1)::bigint as updated, sum((coalesce(seen, 1) > 1)::int)::bigint as again, max(coalesce(seen, 1))::bigint as most from s")
def corpus_seen_totals(spark, d):
    return c.seen_totals(_seen(spark, d))


@query(f"with {SEEN} select p_partkey, coalesce(seen, 1)::bigint as seen from s order by seen desc, p_partkey limit 40")
def corpus_most_seen(spark, d):
    return c.most_seen(_seen(spark, d), "p_partkey")


@query(f"with {EV} select 'type' as facet, type as value, count(*)::bigint as count from ev group by type union all select 'author', author, count(*) from ev group by author union all select 'tag', t, count(*) from (select unnest(tags) as t from ev) group by t union all select 'total', '', count(*) from ev")
def corpus_manifest(spark, d):
    return c.manifest(evidence(spark, d))


@query(f"with {POST}, f as (select token, count(*) as df from post group by token), l as (select list_sort(list(df)) as v, count(*) as n from f) "
       "select n::bigint as vocab, list_sum(v)::bigint as postings, v[n]::bigint as df_max, v[least(n, floor(n * 0.5)::int + 1)]::bigint as p50, v[least(n, floor(n * 0.9)::int + 1)]::bigint as p90, v[least(n, floor(n * 0.99)::int + 1)]::bigint as p99 from l")
def corpus_posting_profile(spark, d):
    return c.posting_profile(x.postings(documents(spark, d), "doc_id"))


@query(f"with {POST} select token, count(*)::bigint as df from post group by token order by df desc, token limit 40")
def corpus_hot_terms(spark, d):
    return c.hot_terms(x.postings(documents(spark, d), "doc_id"))


STOP = ", ".join(f"'{w}'" for w in x.STOP_WORDS)


@query(f"with {POST} select sum((token in ({STOP}))::int)::bigint as stop_postings, count(*)::bigint as postings, round(sum((token in ({STOP}))::int)::double / count(*), 6) as share from post")
def corpus_stopword_share(spark, d):
    return c.stop_share(x.postings(documents(spark, d), "doc_id"))


@query("""with v as (select conv_id, turn, conv_id % 3 as band, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: len(t) >= 2) as toks from conversations),
  k as (select conv_id, arg_max(band, turn) as band, count(*) as versions, len(list_distinct(arg_max(toks, turn))) as now from v group by conv_id),
  e as (select conv_id, count(distinct t) as ever from (select conv_id, unnest(toks) as t from v) group by conv_id),
  b as (select k.*, coalesce(ever, 0) as ever from k left join e using (conv_id))
  select band::bigint as band, count(*)::bigint as docs, sum((versions > 1)::int)::bigint as multi, sum(ever)::bigint as ever, sum(now)::bigint as now, sum((ever > now)::int)::bigint as grew, sum((now = 0)::int)::bigint as empty,
    round(sum(ever)::double / nullif(sum(now), 0), 4) as inflation,
    list_sort(list(round(ever::double / now, 4)) filter (where now > 0))[least(count(*) filter (where now > 0), floor(0.5 * count(*) filter (where now > 0))::int + 1)] as p50,
    list_sort(list(round(ever::double / now, 4)) filter (where now > 0))[least(count(*) filter (where now > 0), floor(0.9 * count(*) filter (where now > 0))::int + 1)] as p90,
    list_sort(list(round(ever::double / now, 4)) filter (where now > 0))[least(count(*) filter (where now > 0), floor(0.99 * count(*) filter (where now > 0))::int + 1)] as p99,
    max(round(ever::double / now, 4)) filter (where now > 0) as most from b group by band""")
def corpus_divergence(spark, d):
    rows = read(spark, d, "conversations").withColumn("band", F.col("conv_id") % 3)
    return c.divergence(rows, "conv_id", "turn", "text", "band")


@query("with n as (select count(*) as n from documents), r as (select doc_id, lang, row_number() over (order by doc_id) - 1 as place from documents), s as (select greatest(1, n // 50) as stride from n) "
       "select place::bigint as place, doc_id, lang from r, s where place % stride = 0 and place < stride * 50")
def sample_stride(spark, d):
    return c.stride_sample(documents(spark, d).select("doc_id", "lang"), "doc_id", 50)


@query("select doc_id, lang, source from documents where lang = 'es' or ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 34 = 0")
def sample_hash_band(spark, d):
    return c.hash_sample(documents(spark, d).select("doc_id", "lang", "source"), "doc_id", 34, F.col("lang") == "es")


ACT = """with a as (select 'e-' || event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at, event_type, (props->>'$.k')::int as k from events where event_type in ('view', 'click')),
  r as (select id, at, k, unnest([0, 1]) as j from a), p as (select 'p' || ((k + j) % 10) as pattern, 'T' || ((k + j) % 10) as title, (k + 10 * j) / 100.0 as score, at from r)
  select pattern, count(*)::bigint as count, round(avg(score), 6) as avg_score, max(at) as last_fired, max(title) as title from p group by pattern"""


@query(ACT)
def activation_report(spark, d):
    k = F.get_json_object("body", "$.k").cast("int")
    hit = [F.struct(F.concat(F.lit("p"), (k + j) % 10).alias("id"), F.concat(F.lit("T"), (k + j) % 10).alias("title"), ((k + 10 * j) / 100.0).alias("score")) for j in (0, 1)]
    body = F.to_json(F.struct(F.when(F.col("type").isin("view", "click"), "context-retrieval").otherwise("other").alias("event"), F.lit("q").alias("query"), F.array(*hit).alias("results")))
    rows = c.activations(evidence(spark, d).withColumn("body", body))
    return rows.select("pattern", "count", F.round("avg_score", 6).alias("avg_score"), "last_fired", "title")
