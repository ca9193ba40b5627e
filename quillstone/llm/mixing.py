"""Mixing sources to target weights by pivotal dependent rounding.

Source s is to supply ``weights[s]`` of ``budget`` characters, so each of its documents is due budget * weight / (the
source's characters) copies: a whole number and a fraction.  The pivotal method rounds the fractions: two documents meet
and, at random, mass moves from one to the other until one of the two is 0 or 1; the other goes on to meet the next.
Every leaf (a bucket of one source) leaves one undecided document at most; these meet in a reduction tree of buckets,
then of sources, and one last document is drawn.  So each source gets its due number of copies to within one, and all
together to within one, while each document keeps its own expectation.

Fractions are integers of 2**-40, so no mass is lost.  Draws are hashes of the seed and the pair, so the result depends
on the rows alone and not on their order or partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import fresh, save

ONE, LEAF, FAN, SEED = 1 << 40, 4096, 64, 17
_M = (1 << 64) - 1


def draw(seed: int, a: int, b: int) -> int:
    """A hash of the pair in 0 .. 2**64-1."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & _M
    for k in (30, 27, 31):
        x ^= x >> k
        x = x * 0xD6E8FEB86659FD93 & _M
    return x ^ (x >> 32)


def pivot(units: list[int], mass: list[int], seed: int) -> list[int]:
    """Masses after rounding: all 0 or ONE but one at most."""
    out, held = list(mass), -1
    for i, m in enumerate(mass):
        if not 0 < m < ONE:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], m
        u = draw(seed, units[held], units[i])
        if a + b < ONE:  # one of them loses all
            if u * (a + b) < b << 64:
                out[held], out[i], held = 0, a + b, i
            else:
                out[held], out[i] = a + b, 0
        else:  # one of them becomes whole
            if u * (2 * ONE - a - b) < (ONE - b) << 64:
                out[held], out[i], held = ONE, a + b - ONE, i
            else:
                out[held], out[i] = a + b - ONE, ONE
        if not 0 < out[held] < ONE:
            held = -1
    return out


_SCHEMA = "source string, skey bigint, node bigint, none boolean, unit bigint, base bigint, mass bigint"


def _meet(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        skey, node, none, unit = (t.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
        mass = t.column(6).to_numpy()
        order = np.lexsort((unit, none, node, skey))
        new = np.ones(len(order), bool)
        s, n, o, u = skey[order], node[order], none[order], unit[order]
        new[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1]) | (o[1:] != o[:-1]) | (u[1:] != u[:-1])
        order = order[new]  # rows of one id are one unit
        s, n, u, m = s[new], n[new], u[new].tolist(), mass[order].tolist()
        edge = np.append(np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])])), len(s)).tolist()
        out: list[int] = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            out += pivot(u[lo:hi], m[lo:hi], seed)
        got = t.take(pa.array(order))
        yield got.set_column(6, "mass", pa.array(out, pa.int64()))

    return run


def copies(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = SEED, leaf: int = LEAF, fan: int = FAN, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, copies): how often each document goes into the mix; 0 means it stays out.

    ``weights`` are relative shares by source, equal for all sources if None; a source that they don't name gets 0.
    ``budget`` is the characters to reach, as many as there are if None.  Defined cases: a null source is a source of
    its own, named by the key None; rows that share source and doc_id are one unit and give one row (also null ids, and any that are no integers); null and
    empty texts have no characters, and a source without any gets no copies; other columns are ignored; an empty table
    gives no rows."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").try_cast("bigint").alias("doc_id"), F.coalesce(F.length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).alias("chars"))
    by = src.groupBy("source").agg(F.count("*").alias("n"), F.sum("chars").cast("double").alias("chars"))
    if weights is None:
        by = by.withColumn("weight", F.lit(1.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        by = by.join(F.broadcast(given), by.source.eqNullSafe(given.name), "left").select("source", "n", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    every = Window.partitionBy()  # one row a source
    whole = F.lit(float(budget)) if budget is not None else F.sum("chars").over(every)
    due = F.coalesce(F.try_divide(whole * F.col("weight"), F.sum("weight").over(every) * F.col("chars")), F.lit(0.0))
    by = by.select(F.col("source").alias("name"), "n", due.alias("due"), F.row_number().over(Window.orderBy("source")).alias("rank"))
    by = by.select("name", F.ceil(F.col("n") / leaf).alias("leaves"), F.floor("due").cast("bigint").alias("base"), F.least(F.round((F.col("due") - F.floor("due")) * ONE), F.lit(float(ONE))).cast("bigint").alias("mass"), "rank")
    by = save(by, "sources")
    most, sources = by.agg(F.max("leaves"), F.max("rank")).first()
    unit = F.coalesce("doc_id", F.lit(0))
    rows = src.join(by, src.source.eqNullSafe(by.name)).select("source", F.xxhash64("source", F.isnull("source")).alias("skey"), F.pmod(F.xxhash64(F.lit(seed), unit), "leaves").alias("node"), F.isnull("doc_id").alias("none"), unit.alias("unit"), "base", "mass")

    done: list[DataFrame] = []

    def level(rows: DataFrame) -> DataFrame:
        out = save(rows.repartition("skey", "node").mapInArrow(_meet(seed + len(done)), _SCHEMA), "pivotal")
        settled = F.col("mass").isin(0, ONE)
        done.append(out.where(settled))
        return out.where(~settled)

    rest = level(rows)
    width = int(most or 1)
    while width > 1:
        width = -(-width // fan)
        rest = level(rest.withColumn("node", F.floor(F.col("node") / fan).cast("bigint")))
    width = int(sources or 1)
    rest = rest.join(F.broadcast(by.select("name", "rank")) if width <= 10_000 else by.select("name", "rank"), F.col("source").eqNullSafe(F.col("name"))).withColumn("node", F.col("rank").cast("bigint"))
    rest = rest.select("source", F.lit(0).cast("bigint").alias("skey"), "node", "none", "unit", "base", "mass")
    while width > 1:
        width = -(-width // fan)
        rest = level(rest.withColumn("node", F.floor(F.col("node") / fan).cast("bigint")))
    chance = F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(ONE))
    out = rest.withColumn("mass", F.when(chance < F.col("mass"), ONE).otherwise(0).cast("bigint"))
    for d in done:
        out = out.unionByName(d.select(*out.columns))
    return out.select(F.when(~F.col("none"), F.col("unit")).alias("doc_id"), "source", (F.col("base") + F.col("mass") / ONE).cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as its copies say; all columns pass through."""
    key, name, n = fresh(docs, "key", "name", "n")
    take = copies(docs, id_col=id_col, source_col=source_col, **how).where("copies > 0").toDF(key, name, n)
    both = docs.join(take.hint("shuffle_hash"), docs[f"`{id_col}`"].try_cast("bigint").eqNullSafe(F.col(key)) & docs[f"`{source_col}`"].cast("string").eqNullSafe(F.col(name)))
    return both.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
