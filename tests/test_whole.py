"""Queries on more rows than the served routes' bounds."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from quillstone.api import Engine
from quillstone.functions.errors import BadRequest
from quillstone.operators import memory
from quillstone.sources.store import Store


def test_a_past_projection_takes_the_first_of_any_number(spark, tmp_path):
    n = 30
    edges = spark.range(n).select(F.format_string("m%02d", "id").alias("id"), F.lit("memory/assert").alias("type"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 2)).alias("endpoints"), F.when(F.col("id") != 1, F.format_string("e%02d", "id")).alias("entry"))
    entries = spark.range(n).select(F.format_string("e%02d", "id").alias("id"), F.lit("note").alias("type"), F.lit("step").alias("claim_type"), F.lit("u").alias("author"), F.lit(None).cast("string").alias("session_id"), F.lit("{}").alias("body"))
    got = [(r.endpoint, r.id, r.entry_id) for r in memory.project_as_of(edges, entries, ["a", "b1", "none"], 3).collect()]
    assert got == [("a", "m00", "e00"), ("a", "m01", None), ("a", "m02", "e02"), ("b1", "m01", None), ("b1", "m03", "e03"), ("b1", "m05", "e05"), ("none", None, None)]
    e = Engine(Store(spark, str(tmp_path)))
    e.store.append_documents("hyperedges", edges)
    with pytest.raises(BadRequest, match="projection-overflow"):  # the served route still refuses
        e.memory_projection(["a"], 3, as_of="2999-01-01T00:00:00Z")


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    """More entries that match than the route's limit of 5000."""
    e = Engine(Store(spark, str(tmp_path_factory.mktemp("shelf"))))
    e.store.append_documents("evidence", spark.range(5200).select(F.col("id").cast("string"), F.lit("doc").alias("type"), F.lit("2020-01-01").alias("at"), F.concat(F.lit("Für b "), "id", F.lit(" c b c d")).alias("body")))
    e.text_catch_up()
    return e


def test_all_matches_of_a_text(shelf):
    assert shelf.text_matches("fur OR zzz").select("id").distinct().count() == 5200
    assert shelf.text_matches("b-c-d").count() == 5200 and shelf.text_matches("b-77-c").select("id").collect()[0].id == "77"
    with pytest.raises(Exception, match="invalid-limit"):  # the served route keeps its bound
        shelf.text_search("fur", 5001)


def test_an_index_is_made_without_a_shuffle(spark):
    from quillstone.operators import text

    docs = spark.createDataFrame([("a", "x y x été z"), ("b", ""), ("c", "y"), ("d", None), ("e", "x")], "id string, text string")
    posts, lengths = text.index(docs)
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = sorted((r.token, r.id, r.tf, r.places, r.dl) for r in posts.collect())
    assert got == [("ete", "a", 1, [3], 5), ("x", "a", 2, [0, 2], 5), ("x", "e", 1, [0], 1), ("y", "a", 1, [1], 5), ("y", "c", 1, [0], 1), ("z", "a", 1, [4], 5)]
    assert {r.id: r.dl for r in lengths.collect()} == {"a": 5, "b": 0, "c": 1, "d": 0, "e": 1}


@pytest.mark.parametrize("slice_", [3, 1 << 20])
def test_postings_of_slices_are_those_of_all(slice_, monkeypatch):
    import pyarrow as pa

    from quillstone.operators import text

    monkeypatch.setattr(text, "SLICE", slice_)
    toks = [["b", "a", "b"], [], ["a"], ["c", "c", "c", "c", "a"], ["a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array("01234"[k] for k in range(5)), pa.array(toks)], ["id", "toks"])
    got = sorted((r["token"], r["id"], r["tf"], r["places"], r["dl"]) for out in text._posted([batch, batch.slice(0, 0)]) for r in out.to_pylist())
    want = sorted((t, str(k), ts.count(t), [i for i, x in enumerate(ts) if x == t], len(ts)) for k, ts in enumerate(toks) for t in set(ts))
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [(100, 100), (0, 100), (0, 0)])
def test_a_condition_finds_the_same_however_many_satisfy_it(spark, tmp_path, monkeypatch, few):
    from quillstone.sources import store as st

    class Few(int):  # the first count is of ids found, the second of ids written again
        left = list(few)

        def __ge__(self, n):
            return n <= Few.left.pop(0)

    s = Store(spark, str(tmp_path))
    row = lambda k, t: ("put", {"id": f"n{k}", "name": "x", "type": t})
    s.write("entities", [row(k, "old") for k in range(8)] + [row(0, "new"), row(1, "new"), row(1, "old")])
    s.write("entities", [row(2, "new"), ("delete", {"id": "n3"}), ("delete", {"id": "n9"})])
    monkeypatch.setattr(st, "FEW", Few())
    got = s.table("entities", where=F.col("type") == "old")
    assert not Few.left[1:] and sorted(r.id for r in got.collect()) == ["n1", "n4", "n5", "n6", "n7"]
    if few == (0, 100):  # ids of one operation aren't shuffled
        once = plan(got).split("Union", 1)[1].split("LeftAnti", 1)[0]
        assert "Aggregate" not in once and "Exchange hash" not in once


def test_a_served_query_writes_the_tables_it_reads(spark, monkeypatch):
    from quillstone.plans import served as s

    monkeypatch.setattr(s, "_kept", {})
    e = s.served(spark, SF, "relations")
    assert e.store.folders("relations") and not any(e.store.folders(t) for t in ("evidence", "hyperedges", "entities"))
    had = e.store.folders("relations")
    assert s.served(spark, SF, "entities", "relations") is e and e.store.folders("entities") and e.store.folders("relations") == had


def test_every_edge_at_an_end(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path)))
    e.store.append_documents("hyperedges", spark.range(5200).select(F.concat(F.lit("h"), "id").alias("id"), F.lit("t").alias("type"), F.array(F.lit("a"), F.col("id").cast("string")).alias("endpoints")))
    assert e.edges_at("a").count() == 5200 and [r.id for r in e.edges_at("77").collect()] == ["h77"] and e.edges_at("a", "other").count() == 0


def test_inhabited_with_many_kinds_needs_no_sets(spark):
    from quillstone.operators import graph

    kinds = [f"k{k:02d}" for k in range(70)]
    entities = spark.createDataFrame([(f"e{k}", t) for k, t in enumerate(kinds)] + [("f", "k00")], "id string, type string")
    edges = spark.createDataFrame([("x", "all", [f"e{k}" for k in range(70)]), ("y", "some", ["e0", "e33", "none"]), ("z", "some", ["f", "e69"])], "id string, type string, endpoints array<string>")
    ask = lambda t, *ks: {"kind": "hyperedge", "type": t, "endpoint_types": list(ks)}
    got = graph.inhabited([ask("all", *kinds), ask("some", "k00", "k33"), ask("some", "k33", "k69"), ask("some", "k00", "k69"), ask("some"), ask("none", "k00")], entities, edges)
    assert [r.inhabited for r in got.collect()] == [True, True, False, True, True, False] and "collect_set" not in plan(got)


def test_the_guard_of_posted_edges_shuffles_once_a_side(spark):
    from quillstone.plans import writes

    assert plan(writes.ingest_noop_guard(spark, SF)).count("Exchange hashpartitioning") == 2


def _saved(monkeypatch, name, look):
    from quillstone.sources import scratch

    true, seen = scratch.save, []

    def save(df, n):
        back = true(df, n)
        if n == name:
            seen.append(look(df, back))
        return back

    monkeypatch.setattr(scratch, "save", save)
    return seen


def test_roots_join_only_what_has_none(spark, monkeypatch):
    from quillstone.operators import evidence as ev

    rows = [(f"a{k}", None) for k in range(50)] + [(f"b{k}", f"a{k}") for k in range(5)] + [("c", "b0"), ("d", "c"), ("x", "y"), ("y", "x"), ("l", "gone")]
    seen = _saved(monkeypatch, "jump", lambda df, back: back.count())
    got = {r.id: (r.root, r.depth) for r in ev.roots(spark.createDataFrame(rows, "id string, in_reply_to string")).collect()}
    assert got["d"] == ("a0", 3) and got["b4"] == ("a4", 1) and got["l"] == ("l", 0) and got["x"] == got["y"] == (None, None) and len(got) == len(rows)
    assert seen[0] == len(rows) and max(seen[1:]) == 9  # later rounds leave the fifty roots alone


def test_long_chains_broadcast_no_links(spark, monkeypatch):
    from quillstone.operators import evidence as ev

    seen = _saved(monkeypatch, "jump", lambda df, back: plan(df))
    entries = spark.createDataFrame([(f"e{k}", f"e{k - 1}" if k else None) for k in range(40)], "id string, in_reply_to string")
    assert [r.id for r in ev.chain(entries, "e39", 2).collect()] == [f"e{k}" for k in range(40)]
    assert len(seen) > 3 and not any("BroadcastHashJoin" in p for p in seen)


def test_a_replay_reads_and_writes_batches_of_several_files(spark):
    from pathlib import Path

    from quillstone.sources.scratch import folder
    from quillstone.streaming import incremental

    at = Path(folder(spark).removeprefix("file://"))
    old = set(at.glob("stream-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = spark.range(2000).select(F.concat(F.lit("i"), F.col("id") % 500).alias("id"), F.concat(F.lit("p"), F.col("id") % 700).alias("endpoint"))
        got = incremental.replay_projection(rows, 3)
        assert sorted(map(tuple, got.collect())) == sorted(set(map(tuple, rows.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (new,) = set(at.glob("stream-*")) - old
    assert len(list((new / "in").glob("*.parquet"))) == 12 and len(list((new / "out").glob("batch=*"))) == 3
