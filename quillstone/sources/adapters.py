"""The document model over the relational fixtures: evidence, hyperedges, entities, relations, an operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.names import stable_hyperedge_id, stable_relation_id

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an append-only evidence log; a reply goes to the event before it in the author's day."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").withColumn("k", k)
    author, day = F.concat(F.lit("user-"), F.col("user_id")), F.date_format("ts", "yyyy-MM-dd")
    ident = F.concat(F.lit("e-"), F.col("event_id"))
    before = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    kind = F.concat(F.lit("k"), F.col("k") % 3)
    return e.select(
        ident.alias("id"), F.col("event_type").alias("type"), F.when(F.col("k") % 2 == 0, "observation").otherwise("step").alias("claim_type"),
        author.alias("author"), F.date_format("ts", ISO).alias("at"), F.concat(author, F.lit("/"), day).alias("session_id"),
        F.lag(ident).over(before).alias("in_reply_to"), F.when(F.col("k") % 11 == 0, F.concat(F.lit("e-"), F.col("event_id") - 1)).alias("fork_of"),
        F.col("props").alias("body"), F.array("event_type", F.concat(F.lit("ns/"), kind)).alias("tags"), F.array("event_type", kind).alias("tag_names"),
        F.struct(F.lit("thread").alias("ref_type"), F.concat(F.lit("t"), F.col("k") % 5).alias("ref_id")).alias("subject"),
        F.concat(F.lit("agent/p"), F.col("k") % 4).alias("pattern_id"), F.when(F.col("k") % 7 == 0, True).when(F.col("k") % 7 == 1, False).alias("ephemeral"),
    )


def hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as edges over an order, a part and a supplier."""
    ends = F.array(F.concat(F.lit("order:"), "l_orderkey"), F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supp:"), "l_suppkey"))
    kind = F.concat(F.lit("order/"), "l_returnflag")
    return read(spark, sf_dir, "lineitem").select(
        stable_hyperedge_id(kind, ends).alias("id"), kind.alias("type"), ends.alias("endpoints"), F.col("l_linestatus").alias("repo"),
        F.concat(F.lit("f"), "l_linenumber", F.lit(".clj")).alias("source_file"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("timestamp"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, customers, suppliers, nations and regions as named, typed nodes."""
    plan = {
        "part": ("p_partkey", "p_name", F.concat(F.lit("item/"), F.lower("p_type")), "item"),
        "customer": ("c_custkey", "c_name", F.concat(F.lit("party/"), F.lower("c_mktsegment")), "party"),
        "supplier": ("s_suppkey", "s_name", F.lit("party/supplier"), "party"),
        "nation": ("n_nationkey", "n_name", F.lit("geo/nation"), "geo"),
        "region": ("r_regionkey", "r_name", F.lit("geo/region"), "geo"),
    }
    short = {"part": "part", "customer": "cust", "supplier": "supp", "nation": "nation", "region": "region"}
    out = None
    for table, (key, name, kind, source) in plan.items():
        one = read(spark, sf_dir, table).select(F.concat(F.lit(short[table] + ":"), F.col(key)).alias("id"), F.col(name).alias("name"), kind.alias("type"), F.lit(source).alias("source"), F.col(key).cast("string").alias("external_id"))
        out = one if out is None else out.unionByName(one)
    return out


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as binary typed edges."""
    plan = [
        ("nation", "nation:", "n_nationkey", "geo/in-region", "region:", "n_regionkey"), ("customer", "cust:", "c_custkey", "geo/in-nation", "nation:", "c_nationkey"),
        ("supplier", "supp:", "s_suppkey", "geo/in-nation", "nation:", "s_nationkey"), ("orders", "order:", "o_orderkey", "order/placed-by", "cust:", "o_custkey"),
    ]
    out = None
    for table, a, src, kind, b, dst in plan:
        one = read(spark, sf_dir, table).select(F.lit(kind).alias("type"), F.concat(F.lit(a), F.col(src)).alias("src"), F.concat(F.lit(b), F.col(dst)).alias("dst"))
        out = one if out is None else out.unionByName(one)
    return out.select(stable_relation_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", "src", "dst", F.col("src").alias("from"), F.col("dst").alias("to"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as bitemporal operations: opened, settled two days late, deleted where finished, some corrected later."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k"))

    def day(n: int):
        return F.col("d") + F.make_dt_interval(F.lit(n))

    def op(rows: DataFrame, kind: str, start, stop, at, n: int, state) -> DataFrame:
        return rows.select("id", F.lit(kind).alias("op"), start.alias("valid_from"), stop.cast("timestamp_ntz").alias("valid_to"), at.alias("system_time"), (4 * F.col("k") + n).alias("ordinal"), state.cast("string").alias("state"))

    none = F.lit(None)
    return (
        op(o, "put", day(0), none, day(0), 0, F.lit("open")).unionByName(op(o, "put", day(10), none, day(12), 1, F.col("s")))
        .unionByName(op(o.where("s = 'F'"), "delete", day(30), none, day(30), 2, none)).unionByName(op(o.where("k % 10 = 0"), "put", day(-5), day(0), day(40), 3, F.lit("quote")))
    )


def memory_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as memory assertions: an edge over the entry, a pattern and the author; some name no entry."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    entry = F.concat(F.lit("e-"), F.col("event_id"))
    return e.select(
        F.concat(F.lit("hx:memory-"), F.col("event_id")).alias("id"), F.lit("memory/assert").alias("type"),
        F.array(entry, F.concat(F.lit("pattern/"), F.col("k") % 4), F.concat(F.lit("user-"), "user_id")).alias("endpoints"),
        F.when(F.col("k") % 9 == 0, F.lit(None)).when(F.col("k") % 13 == 0, F.lit("e-missing")).otherwise(entry).alias("entry"), F.col("ts"), F.col("k"),
    )


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on the memory edges: put when made, deleted after five days where k divides by six."""
    m = memory_edges(spark, sf_dir)
    cols = [F.col("id"), F.col("type"), F.col("endpoints"), F.col("entry")]
    end = F.lit(None).cast("timestamp_ntz").alias("valid_to")
    gone = F.col("ts") + F.make_dt_interval(F.lit(5))
    put = m.select(F.lit("put").alias("op"), F.col("ts").alias("valid_from"), end, F.col("ts").alias("system_time"), F.lit(0).alias("ordinal"), *cols)
    return put.unionByName(m.where("k % 6 = 0").select(F.lit("delete").alias("op"), gone.alias("valid_from"), end, gone.alias("system_time"), F.lit(1).alias("ordinal"), *cols))
