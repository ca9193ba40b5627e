"""Tokens, postings, boolean matching and ranked search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.errors import BadRequest

STOP_WORDS = sorted("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
K1, B = 1.2, 0.75


def ascii_tokens(c: Column, least: int = 1) -> Column:
    """Runs of ASCII letters and digits, lower case, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def word_tokens(c: Column) -> Column:
    """Distinct runs of letters and digits of any script, two characters at least."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{IsDigit}]+"), lambda t: F.length(t) >= 2))


@cache
def _bare() -> tuple[str, str]:
    """Characters with diacritics and what they are without; combining diacritics at the end, which have nothing."""
    marks = {chr(k) for k in range(0x300, 0x370)}
    pairs = [(c, d[0]) for c in map(chr, range(0x80, 0xFFFF)) if c not in marks and len(d := unicodedata.normalize("NFD", c)) > 1 and marks.issuperset(d[1:])]
    return "".join(c for c, _ in pairs) + "".join(sorted(marks)), "".join(d for _, d in pairs)


def fold(text: str) -> list[str]:
    """Tokens of a query, as ``folded_tokens`` has them."""
    have, bare = _bare()
    table = {ord(c): bare[k] if k < len(bare) else None for k, c in enumerate(have)}
    return re.findall(r"[^\W_]+", text.lower().translate(table))


def folded_tokens(c: Column, least: int = 1) -> Column:
    """Runs of letters and digits of any script, lower case and without diacritics, in order."""
    have, bare = _bare()
    return F.filter(F.split(F.translate(F.lower(c), have, bare), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def body_text(body: Column) -> Column:
    """A body as text: JSON punctuation separates tokens as well as any other."""
    return F.coalesce(body, F.lit(""))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", least: int = 2, tokens: Callable[..., Column] = ascii_tokens) -> DataFrame:
    """(id, token, tf)."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col), least)).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("tf"))


#: Tokens that are posted at once.
SLICE = 1 << 20


def _posted(batches):
    """Postings of (id, dl, toks), in order of token within some documents at a time: no posting of a document waits for
    another's, so nothing is shuffled, and few pages have a token."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def some(b):
        toks, n = b.column("toks"), b.num_rows
        flat, size = toks.flatten(), pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        key = rank[coded.indices.to_numpy()] * n + np.repeat(np.arange(n), size)  # by token, then document
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        word, doc = np.divmod(key[first], n)
        ends = np.r_[first, len(key)]
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[by], pa.int32()))
        dl = pa.array(size[doc], pa.int32())
        got = [coded.dictionary.take(order).take(pa.array(word)), b.column("id").take(pa.array(doc)), pa.array(np.diff(ends), pa.int32()), places, dl]
        return pa.RecordBatch.from_arrays(got, ["token", "id", "tf", "places", "dl"])

    for b in batches:
        size = pc.list_value_length(b.column("toks")).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE
        for begin, end in zip(cuts := [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()], [*cuts[1:], b.num_rows]):
            if size[begin:end].sum():
                out = some(b.slice(begin, end - begin))
                yield from (out.slice(k, 1 << 16) for k in range(0, out.num_rows, 1 << 16))


def index(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings with places (token, id, tf, places, dl) and documents with their length (id, dl), for ``search_index``.
    A document is one row."""
    toks = docs.select(F.col(id_col).alias("id"), folded_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("toks"))
    kind = toks.schema["id"].dataType.simpleString()
    posts = toks.mapInArrow(_posted, f"token string, id {kind}, tf int, places array<int>, dl int")
    return posts, toks.select("id", F.size("toks").alias("dl"))


def parse_match(query: str) -> list[list[list[str]]]:
    """A query as alternatives of phrases that must all occur: words are quoted, AND and OR in upper case are operators, words
    side by side are AND, and OR binds least.  A word with inner punctuation is a phrase of its parts."""
    words = query.split()
    if not words:
        raise BadRequest("blank-query")
    any_: list[list[list[str]]] = [[]]
    operator = True
    for w in words:
        if w in ("AND", "OR"):
            if operator:
                raise BadRequest("misplaced-operator", query=query)
            operator = True
            if w == "OR":
                any_.append([])
            continue
        phrase = fold(w)
        if phrase:
            any_[-1].append(phrase)
        operator = False
    if operator:
        raise BadRequest("misplaced-operator", query=query)
    return [a for a in any_ if a]


def terms(match: list[list[list[str]]]) -> list[str]:
    return sorted({t for a in match for p in a for t in p})


def matches(tokens: Column, match: list[list[list[str]]]) -> Column:
    """Whether an array of tokens in order satisfies a parsed query."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))

    def phrase(p: list[str]) -> Column:
        return F.array_contains(tokens, p[0]) if len(p) == 1 else joined.contains(" " + " ".join(p) + " ")

    out = F.lit(False)
    for a in match:
        every = F.lit(True)
        for p in a:
            every = every & phrase(p)
        out = out | every
    return out


def search(docs: DataFrame, query: str, limit: int | None = 10, id_col: str = "id", text_col: str = "text", tokens: Callable[..., Column] = folded_tokens) -> DataFrame:
    """Documents that match, with their BM25 score (lower is better), best first.

    One scan: documents that match carry their term counts on; the corpus figures (documents, mean length, document
    frequencies) are one aggregation that is joined back as a single row."""
    match = parse_match(query)
    words = terms(match)
    toks = docs.select("*", tokens(F.col(text_col)).alias("toks"))
    tf = [F.size(F.filter("toks", (lambda w: lambda t: t == w)(w))) for w in words]
    figures = toks.select(F.size("toks").alias("dl"), *[F.array_contains("toks", w).cast("int").alias(f"d{k}") for k, w in enumerate(words)])
    figures = figures.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(f"d{k}").alias(f"df{k}") for k in range(len(words))])
    hits = toks.where(matches(F.col("toks"), match)).select(*docs.columns, F.size("toks").alias("dl"), *[c.alias(f"tf{k}") for k, c in enumerate(tf)]).crossJoin(F.broadcast(figures))
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(1e-6))
        tfk = F.col(f"tf{k}")
        score = score - idf * tfk * (K1 + 1) / (tfk + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = hits.select(*docs.columns, score.alias("score")).orderBy("score", id_col)
    return out if limit is None else out.limit(limit)


def _weighed(mine: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings of a query's tokens with the corpus figures they are scored by, one row a token and one row in all."""
    df = mine.groupBy("token").agg(F.count("*").alias("df"))
    all_ = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return mine.join(F.broadcast(df), "token").crossJoin(F.broadcast(all_))


def _score() -> Column:
    part = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (-F.sum(part)).alias("score")


def search_postings(posts: DataFrame, lengths: DataFrame, query: str, limit: int | None = 10, id_col: str = "id") -> DataFrame:
    """The same ranking from kept postings (id, token, tf) and lengths (id, dl); phrases count as all their words."""
    match = [[[t] for p in a for t in p] for a in parse_match(query)]
    rows = _weighed(posts.where(F.col("token").isin(terms(match))), lengths).join(lengths, id_col)
    out = rows.groupBy(id_col).agg(F.collect_set("token").alias("toks"), _score()).where(matches(F.col("toks"), match))
    out = out.select(id_col, "score").orderBy("score", id_col)
    return out if limit is None else out.limit(limit)


def search_index(posts: DataFrame, lengths: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """(id, score) from an ``index``: only the query's tokens are read, and phrases are held against their places."""
    match = parse_match(query)
    words = {t: f"at{k}" for k, t in enumerate(terms(match))}
    rows = _weighed(posts.where(F.col("token").isin(list(words))), lengths)
    at = [F.flatten(F.collect_list(F.when(F.col("token") == t, F.col("places")))).alias(c) for t, c in words.items()]
    out = rows.groupBy("id").agg(*at, _score())

    def phrase(p: list[str]) -> Column:
        begin = F.col(words[p[0]])
        for k, t in enumerate(p[1:], 1):
            begin = F.array_intersect(begin, F.transform(words[t], (lambda k: lambda x: x - k)(k)))
        return F.size(begin) > 0

    held = F.lit(False)
    for a in match:
        every = F.lit(True)
        for p in a:
            every = every & phrase(p)
        held = held | every
    out = out.where(held).select("id", "score").orderBy("score", "id")
    return out if limit is None else out.limit(limit)


def index_stats(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows, rows in the index, rows that wait for it, tokens, and the last time."""
    held = docs.select("id", "at").join(lengths, "id", "left")
    return held.agg(F.count("*").alias("rows"), F.count("dl").alias("indexed"), F.count(F.when(F.col("dl").isNull(), 1)).alias("pending"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.max("at").alias("last_at"))
