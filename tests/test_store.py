"""Commits: all tables of a write or none, one writer after the other, and nothing lost on the way."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillstone.api import Engine
from quillstone.functions.errors import BadRequest, Refused
from quillstone.operators import evidence as ev, text
from quillstone.sources.store import Conflict, Store
from test_api import Clock
from test_plans import plan


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), Clock())


def entity(k, **more):
    return {"id": f"n{k}", "name": f"name {k}", "type": "t"} | more


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_a_write_that_fails_half_way_leaves_no_trace(spark, store):
    store.write("entities", [("put", entity(1))])
    bad = spark.range(1).select(F.lit("put").alias("op"), F.raise_error(F.lit("lost")).cast("string").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"entities": store.ops("entities", [("put", entity(2))]), "relations": bad})
    assert ids(store.table("entities")) == ["n1"] and store.log("relations").count() == 0 and store.version == 1
    store.write("entities", [("put", entity(3))])
    assert ids(store.table("entities")) == ["n1", "n3"] and store.vacuum() >= 1 and ids(store.table("entities")) == ["n1", "n3"]


def test_a_commit_file_cut_off_by_a_crash_is_passed_over(store, tmp_path):
    store.write("entities", [("put", entity(1))])
    (tmp_path / "store" / "commits" / f"{2:020d}.json").write_text('{"tables": {"ent')
    assert ids(store.table("entities")) == ["n1"]
    store.write("entities", [("put", entity(2))])
    assert ids(store.table("entities")) == ["n1", "n2"] and store.version == 3


def test_of_two_writers_one_goes_first(spark, store):
    other = Store(spark, store.path, store.clock)
    base = store.version
    other.write("entities", [("put", entity(1, name="first"))])
    with pytest.raises(Conflict):
        store.commit({"entities": store.ops("entities", [("put", entity(1, name="second"))])}, base=base)
    at = datetime(2026, 8, 1, tzinfo=timezone.utc)
    frozen = [Store(spark, store.path, lambda: at) for _ in range(2)]
    for s, name in zip(frozen, ("third", "fourth")):  # one moment, two stores: the later commit holds
        s.write("entities", [("put", entity(1, name=name))])
    assert store.table("entities").first().name == "fourth"


def test_an_append_is_judged_again_after_a_conflict(spark, store):
    one, two = Engine(store), Engine(Store(spark, store.path, store.clock))
    doc = {"id": "e", "type": "note", "claim-type": "x", "author": "a"}
    version, raced = Store.version, []

    class Racing(Store):
        @property
        def version(self):
            got = version.fget(self)
            if not raced:
                raced.append(two.evidence_append(doc))
            return got

    with pytest.raises(Refused) as x:
        Engine(Racing(spark, store.path, store.clock)).evidence_append(doc)
    assert x.value.reason == "duplicate-id" and one.evidence_count() == 1


def test_erase_and_compact_keep_the_rest(store):
    for k in range(4):
        store.write("entities", [("put", entity(k)), ("put", entity(k + 10))])
    store.write("entities", [("delete", entity(0))])
    before = sorted(map(tuple, store.log("entities").collect()), key=repr)
    store.compact()
    assert sorted(map(tuple, store.log("entities").collect()), key=repr) == before and len(store.folders("entities")) == 1
    store.erase("entities", store.log("entities").where("id in ('n0', 'n11')").select("id"))
    assert ids(store.log("entities").distinct()) == ["n1", "n10", "n12", "n13", "n2", "n3"] and store.vacuum() >= 0
    store.erase("relations", store.log("entities").select("id"))
    store.compact()
    assert ids(store.table("entities")) == ["n1", "n10", "n12", "n13", "n2", "n3"]


def test_reads_push_their_conditions_to_the_scan(spark, store):
    store.write("entities", [("put", entity(1))])
    e = Engine(store)
    e.evidence_append({"id": "e", "type": "note", "claim-type": "x", "author": "a", "body": "word"})
    assert "EqualTo(id,n1)" in plan(store.table("entities").where("id = 'n1'"))
    assert "EqualTo(name,x)" in plan(store.table("entities", where=F.col("name") == "x"))
    p = plan(ev.newest(ev.select(store.table("evidence"), type="note", author="a"), 5))
    assert "EqualTo(type,note)" in p and "EqualTo(author,a)" in p and "TakeOrderedAndProject" in p and "Exchange" not in p and "Aggregate" not in p
    assert "EqualTo(token,word)" in plan(text.search_index(store.log("postings"), store.log("text-docs"), "word"))


def test_where_judges_the_version_that_holds(store):
    store.write("entities", [("put", entity(1, type="old"))])
    store.write("entities", [("put", entity(1, type="new"))])
    assert ids(store.table("entities", where=F.col("type") == "old")) == [] and ids(store.table("entities", where=F.col("type") == "new")) == ["n1"]


def test_text_of_any_script_is_found(store):
    e = Engine(store)
    base = {"type": "note", "claim-type": "x", "author": "a"}
    for k, body in enumerate(("Café society", "日本 license", "a license of Japan", "the mission, re-read; plan b", "plan of the mission")):
        e.evidence_append(base | {"id": f"e{k}", "body": body})
    found = lambda q: ids(e.text_search(q))
    assert found("cafe") == found("CAFÉ") == ["e0"] and found("日本 license") == ["e1"] and found("日本") == ["e1"] and found("license") == ["e1", "e2"]
    assert found("re-read") == ["e3"] and found("mission-re") == ["e3"] and found("read-re") == [] and found("mission-plan") == [] and found("mission plan") == ["e3", "e4"]
    late = store.ops("evidence", [("put", {"id": "e9", "type": "note", "author": "a", "at": "2026", "body": "late café"})])
    store.commit({"evidence": late})
    stats = e.text_stats().first()
    assert (stats.rows, stats.indexed, stats.pending) == (6, 5, 1) and found("cafe") == ["e0"]
    assert e.text_catch_up() == 1 and e.text_catch_up() == 0 and found("cafe") == ["e0", "e9"]
    with pytest.raises(BadRequest):
        e.text_search("  ")


@pytest.mark.parametrize("steps", [32, 2])
def test_chains_of_any_length(spark, steps):
    rows = [(f"e{k}", f"e{k - 1}" if k else None) for k in range(130)] + [("x", "y"), ("y", "z"), ("z", "x"), ("lost", "gone"), ("l2", "lost")]
    entries = spark.createDataFrame(rows, "id string, in_reply_to string")
    chain = lambda i: [(r.id, r.depth) for r in ev.chain(entries, i, steps).collect()]
    assert chain("e129") == [(f"e{k}", k) for k in range(130)] and chain("e3") == [(f"e{k}", k) for k in range(4)]
    assert [i for i, _ in chain("x")] == ["z", "y", "x"] and chain("l2") == [("lost", 0), ("l2", 1)] and chain("nobody") == []
