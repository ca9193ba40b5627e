"""Corpus analytics: field census, histograms, posting profiles, token divergence, samples."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import text


def _leaves(x, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(x, str):
        yield path, x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from _leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(x, list):
        for v in x:
            yield from _leaves(v, f"{path}.*" if path else "*")


def string_leaves(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, chars) of every string in a JSON document; elements of a list share the path "*"."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, paths, sizes = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for path, s in _leaves(json.loads(t), "") if t else ():
                    ids.append(k)
                    paths.append(path)
                    sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["id", "path", "chars"])

    return docs.select(id_col, json_col).mapInArrow(run, f"id {kind}, path string, chars bigint")


def field_census(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """By key path: strings, their characters, the longest, and the documents that have some."""
    return string_leaves(docs, id_col, json_col).groupBy("path").agg(F.count("*").alias("strings"), F.sum("chars").alias("chars"), F.max("chars").alias("max_chars"), F.countDistinct("id").alias("docs"))


def histogram(rows: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias("count"))


def seen_totals(rows: DataFrame, seen: str = "seen") -> DataFrame:
    """Documents, updates, documents seen again and the most often seen; a missing count is one."""
    n = F.coalesce(F.col(seen), F.lit(1))
    return rows.agg(F.count("*").alias("total"), F.sum(n - 1).alias("updated"), F.sum((n > 1).cast("int")).alias("again"), F.max(n).alias("most"))


def nearest_rank(rows: DataFrame, value: str, shares: list[float], by: list[str] = []) -> DataFrame:
    """Values at sorted place min(n-1, floor(p*n)), one column a share: counts of equal values are summed in order, so
    no group's values are collected."""
    runs = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(value)
    upto = runs.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    at = [F.min(F.when(F.col("upto") > F.least(F.col("all") - 1, F.floor(F.col("all") * p)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return upto.groupBy(*by).agg(*at)


def posting_profile(posts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Vocabulary, postings and document frequencies at 50, 90 and 99 % and at most."""
    df = posts.groupBy("token").agg(F.count(id_col).alias("df"))
    all_ = df.agg(F.count("*").alias("vocab"), F.sum("df").alias("postings"), F.max("df").alias("df_max"))
    return all_.crossJoin(nearest_rank(df, "df", [0.5, 0.9, 0.99]))


def hot_terms(posts: DataFrame, n: int = 40) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(n)


def stop_share(posts: DataFrame, stop: list[str] = text.STOP_WORDS) -> DataFrame:
    """Postings of stop words, of all, and their share."""
    hit = F.sum(F.col("token").isin(stop).cast("int"))
    return posts.agg(hit.alias("stop_postings"), F.count("*").alias("postings"), F.round(F.try_divide(hit, F.count("*")), 6).alias("share"))


def divergence(versions: DataFrame, key: str, version: str, text_col: str, band: str) -> DataFrame:
    """By band: documents, those of several versions, tokens ever held and held now, documents that lost some, documents
    with none now, the inflation, and ranks of the documents' own ratios."""
    toks = versions.select(key, version, band, text.ascii_tokens(F.col(text_col), 2).alias("toks"))
    docs = toks.groupBy(key).agg(F.max_by(band, version).alias("band"), F.count("*").alias("versions"), F.size(F.array_distinct(F.max_by("toks", version))).alias("now"))
    ever = toks.select(key, F.explode("toks").alias("t")).distinct().groupBy(key).agg(F.count("*").alias("ever"))
    both = docs.join(ever, key, "left").withColumn("ever", F.coalesce("ever", F.lit(0)))
    ratio = both.where("now > 0").withColumn("ratio", F.round(F.col("ever") / F.col("now"), 4))
    ranks = nearest_rank(ratio, "ratio", [0.5, 0.9, 0.99], ["band"]).join(ratio.groupBy("band").agg(F.max("ratio").alias("most")), "band")
    s = lambda c: F.sum(c.cast("int"))
    sums = both.groupBy("band").agg(
        F.count("*").alias("docs"), s(F.col("versions") > 1).alias("multi"), F.sum("ever").alias("ever"), F.sum("now").cast("bigint").alias("now"),
        s(F.col("ever") > F.col("now")).alias("grew"), s(F.col("now") == 0).alias("empty"), F.round(F.try_divide(F.sum("ever"), F.sum("now")), 4).alias("inflation"),
    )
    return sums.join(ranks, "band", "left")


def manifest(rows: DataFrame, type_col: str = "type", author_col: str = "author", tags_col: str = "tags") -> DataFrame:
    """(facet, value, count) by type, author and tag, and the total: what a slice of the log holds."""
    facets = F.array(
        F.struct(F.lit("type").alias("facet"), F.col(type_col).alias("value")), F.struct(F.lit("author").alias("facet"), F.col(author_col).alias("value")), F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")),
    )
    tags = F.transform(F.coalesce(F.col(tags_col), F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value")))
    return rows.select(F.explode(F.concat(facets, tags)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("count"))


def most_seen(rows: DataFrame, key: str, seen: str = "seen", n: int = 40) -> DataFrame:
    """The documents seen most often."""
    return rows.select(key, F.coalesce(seen, F.lit(1)).alias("seen")).orderBy(F.desc("seen"), key).limit(n)


def stride_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every stride-th row in order, ``n`` at most; the stride is floor(total / n).

    Places come from range-partitioned counts, not from one global window, so no task sorts the whole table, and only the
    column of the order is moved: the chosen values, ``n`` at most, are then looked up in the table as it stands."""
    from ..sources.scratch import fresh, save

    total = rows.count()
    stride = max(1, total // max(1, n))
    ordered = rows.select(order).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = save(ordered.withColumn("mono", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("mono", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    at = F.col("before") + F.col("mono").bitwiseAND((1 << 33) - 1)
    every = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", at)
    chosen = every.where((F.col("place") % stride == 0) & (F.col("place") < stride * n)).select("place", F.col(order).alias("value"))
    # of equal values the first so many rows are taken: which of them an order leaves open
    wanted = chosen.select(F.col("value").alias("wanted")).distinct()
    first = every.join(F.broadcast(wanted), F.col(order).eqNullSafe(F.col("wanted"))).withColumnRenamed("wanted", "value").groupBy("value").agg(F.min("place").alias("first")).toDF("same", "first")
    chosen = save(chosen.join(first, F.col("value").eqNullSafe(F.col("same"))).select("place", "value", (F.col("place") - F.col("first") + 1).alias("nth")), "chosen")
    value, nth = fresh(rows, "value", "nth")
    found = rows.join(F.broadcast(chosen.select(F.col("value").alias(value)).distinct()), F.col(order).eqNullSafe(F.col(value)))
    found = found.withColumn(nth, F.row_number().over(Window.partitionBy(value).orderBy(value)))
    return found.join(F.broadcast(chosen), F.col(value).eqNullSafe(F.col("value")) & (F.col(nth) == F.col("nth"))).select("place", *[F.col(c) for c in rows.columns])


def hash_sample(rows: DataFrame, key: str, one_in: int, keep: Column | None = None) -> DataFrame:
    """Rows whose key hashes to 0 modulo ``one_in`` (by the first 32 bits of its MD5), and all that ``keep``."""
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % one_in == 0
    return rows.where(drawn if keep is None else keep | drawn)


def activations(evidence: DataFrame, since: str | None = None, limit: int | None = None) -> DataFrame:
    """By pattern of context retrievals: how often, mean score, last time, title and the activations, newest first."""
    rows = evidence.where(F.get_json_object("body", "$.event") == "context-retrieval")
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    hits = rows.select("id", "at", "author", "session_id", F.substring(F.get_json_object("body", "$.query"), 1, 240).alias("query"), F.explode(F.from_json(F.get_json_object("body", "$.results"), "array<struct<id string, title string, score double>>")).alias("r"))
    act = F.struct(F.col("at"), F.col("id").alias("evidence_id"), F.col("r.score").alias("score"), F.col("r.title").alias("title"), "session_id", F.col("author").alias("agent_id"), "query")
    out = hits.groupBy(F.col("r.id").alias("pattern")).agg(F.count("*").alias("count"), F.avg("r.score").alias("avg_score"), F.max("at").alias("last_fired"), F.max_by("r.title", F.struct("at", "id")).alias("title"), F.sort_array(F.collect_list(act), asc=False).alias("activations"))
    out = out.orderBy(F.desc("count"), "pattern")
    return out if limit is None else out.limit(limit)
