"""The served surface on small corpora with known answers."""

from datetime import datetime, timedelta, timezone

import pytest

from quillstone.api import Engine
from quillstone.functions import names
from quillstone.functions.errors import BadRequest, NotFound, Refused
from quillstone.sources.store import Store

NOW = datetime(2026, 7, 20, tzinfo=timezone.utc)


class Clock:
    def __init__(self):
        self.now = NOW

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


def ids(rows):
    return [r.id for r in rows.collect()]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    e = Engine(Store(spark, str(tmp_path_factory.mktemp("log")), Clock()))
    day = "2026-07-10T{}:00:00Z"
    for d in (
        {"id": "ph-body", "type": "claim", "claim-type": "x", "author": "t", "at": "2026-07-09T00:00:00Z"},
        {"evidence/id": "e1", "id": "ignored", "type": ":claim", "claim-type": "x", "author": "alice", "at": day.format(10), "session-id": "s1", "tags": [":alpha", ":beta"], "subject": {"ref/type": ":thread", "ref/id": "t1"}, "pattern-id": ":agent/pause", "body": {"text": "Mission substrate, re-read"}},
        {"id": "e2", "type": "note", "claim-type": "x", "author": "bob", "at": day.format(11), "session-id": "s1", "tags": ["alpha", ":single/live"], "in-reply-to": "e1", "body": "mission plan"},
        {"id": "e3", "type": "claim", "claim-type": "x", "author": "alice", "at": day.format(12), "session-id": "s2", "in-reply-to": "e2"},
        {"id": "e4", "type": "note", "claim-type": "x", "author": "carol", "at": day.format(13), "tags": ["beta"], "ephemeral?": True},
    ):
        e.evidence_append(d)
    return e


def test_pages_filters_and_cursors(log):
    page = lambda **k: ids(log.evidence_page(**k).entries)
    assert page(type="claim") == ["e3", "e1", "ph-body"] and page(author="alice", type=":claim") == ["e3", "e1"]
    assert page(since="2026-07-10T12:00:00Z") == ["e4", "e3"] and page(before="2026-07-10T11:00:00Z") == ["e1", "ph-body"]
    assert page(since="2026-07-10") == ["e4", "e3", "e2", "e1"]
    assert page(tags="alpha,beta") == ["e1"] and page(tags="live") == ["e2"] and page(tags="single/live") == []
    assert page(subject_type="thread", subject_id="t1") == ["e1"] and page(pattern_id="agent/pause") == ["e1"]
    assert page(include_ephemeral="false") == ["e3", "e2", "e1", "ph-body"] and len(page()) == 5
    first = log.evidence_page(limit=2)
    assert ids(first.entries) == ["e4", "e3"] and first.count == 2
    second = log.evidence_page(limit=2, cursor_at=first.next_cursor[0], cursor_id=first.next_cursor[1])
    assert ids(second.entries) == ["e2", "e1"]
    assert page(session_id="s1", limit=1) == ["e2"] and log.evidence_page().next_cursor is None
    for bad in (0, 1001, "not-a-number"):
        with pytest.raises(BadRequest) as x:
            log.evidence_page(limit=bad)
        assert x.value.status == 400


def test_counts_sessions_and_chains(log):
    assert log.evidence_count(type="note") == 2
    rows, total = log.evidence_sessions()
    got = rows.collect()
    assert [r.session_id for r in got] == ["s2", "s1"] and got[0].types == [":claim"] and got[1].authors == ["alice", "bob"] and got[1]["count"] == 2
    assert tuple(total.first()) == (2, 3)
    assert log.evidence_sessions(author="alice")[0].count() == 2
    assert ids(log.evidence_chain("e3")) == ["e1", "e2", "e3"] and ids(log.evidence_chain("nobody")) == []
    assert log.evidence("e1")["author"] == "alice"
    with pytest.raises(NotFound):
        log.evidence("nobody")


def test_appends_are_judged_in_order(log):
    base = {"type": "note", "claim-type": "x", "author": "a"}
    for doc, status, reason in (
        ({"claim-type": "x", "author": "a"}, 400, "evidence/type required"), ({"type": "n", "author": "a"}, 400, "evidence/claim-type required"), ({"type": "n", "claim-type": "x"}, 400, "evidence/author required"),
        (base | {"id": "e1", "in-reply-to": "nobody", "fork-of": "nobody"}, 409, "reply-not-found"), (base | {"id": "e1", "fork-of": "nobody"}, 409, "fork-not-found"), (base | {"id": "e1"}, 409, "duplicate-id"),
    ):
        with pytest.raises(Refused) as x:
            log.evidence_append(doc)
        assert (x.value.status, x.value.reason) == (status, reason)
    guarded = Engine(log.store, penholders={"joe"})
    with pytest.raises(Refused) as x:
        guarded.evidence_append(base, penholder="eve")
    assert x.value.status == 403


def test_text_and_memory_search(log):
    assert ids(log.text_search("mission")) == ["e2", "e1"] or set(ids(log.text_search("mission"))) == {"e1", "e2"}
    assert ids(log.text_search("mission substrate")) == ["e1"] and ids(log.text_search("re-read")) == ["e1"] and ids(log.text_search("mission", author="bob")) == ["e2"]
    assert set(ids(log.text_search("substrate OR plan"))) == {"e1", "e2"} and ids(log.text_search("substrate AND plan")) == []
    for bad in (" ", "AND x", "x OR", "x AND OR y"):
        with pytest.raises(BadRequest):
            log.text_search(bad)
    assert set(ids(log.memory_search(tags="alpha,beta"))) == {"e1", "e2", "e4"} and ids(log.memory_search(text="mission", tags="alpha", type="note")) == ["e2"]
    stats = log.text_stats().first()
    assert (stats.rows, stats.last_at) == (5, "2026-07-10T13:00:00Z")


@pytest.fixture(scope="module")
def net(spark, tmp_path_factory):
    e = Engine(Store(spark, str(tmp_path_factory.mktemp("net")), Clock()), models={"gadget": {"id_pattern": "^[a-z]", "queue": ["^Q"]}})
    for i, (n, t, more) in enumerate([("Widget", "gadget", {}), ("Gizmo", "gadget", {"source": "t", "external-id": "g-1"}), ("Sprocket", "gadget", {}), ("a", "left-kind", {}), ("b", "right-kind", {})]):
        e.entity_ensure({"id": f"n{i}", "name": n, "type": t} | more)
    e.relation_upsert({"type": "uses", "from": "Widget", "to": {"name": "Sprocket"}})
    for kind, ends, props in (("test/edge", ["a", "b"], {"repo": "r1", "source-file": "f.clj"}), ("test/edge", ["b", "c"], {"repo": "r2"}), ("other/edge", ["a", "z"], {}), ("code/commit", ["old"], {"timestamp": 10, "repo": "r1"}), ("code/commit", ["new"], {"timestamp": 20, "repo": "r1"})):
        e.hyperedge_upsert({"hx/type": kind, "hx/endpoints": ends, "hx/props": props})
    return e


def test_hyperedge_reads(net):
    one = net.hyperedges(type="test/edge", limit=1)
    assert (one.rows.count(), one.count, one.count_exact) == (1, 2, True)
    assert (net.hyperedges(type="test/edge", limit=1, include_total=False).count, net.hyperedges(type="test/edge", repo="r1").count) == (1, 1)
    assert net.hyperedges(type="code/commit", latest=True).rows.first().endpoints == ["new"]
    assert net.hyperedges(end="a").count == 2 and net.hyperedges(end="a", type=":test/edge").count == 1 and net.hyperedges(end="a", type="absent/edge").count == 0
    assert net.hyperedge("hx:test/edge:a.b")["repo"] == "r1"
    with pytest.raises(BadRequest):
        net.hyperedges()
    assert net.census(type="test/edge")["count"] == 2 and net.census(entity_type="gadget")["count"] == 3


def test_hyperedge_writes(net):
    doc = {"hx/type": "code/v05/commit", "hx/endpoints": ["commit:x:abc"], "hx/props": {"repo": "q", "timestamp": 1720000000000}, "hx/labels": ["l"]}
    first = net.hyperedge_upsert(doc)
    assert first.doc["id"] == "hx:code/v05/commit:commit:x:abc" and not first.no_op and net.hyperedge_upsert(doc).no_op
    assert net.hyperedge_upsert({k: v for k, v in doc.items() if k != "hx/labels"}).no_op and net.hyperedge(first.doc["id"])["labels"] == ["l"]
    assert not net.hyperedge_upsert(doc | {"hx/props": {"repo": "other"}}).no_op
    net.hyperedge_upsert({"op": "retract", "hx/id": first.doc["id"]})
    with pytest.raises(NotFound):
        net.hyperedge(first.doc["id"])
    with pytest.raises(Refused) as x:
        net.hyperedge_upsert({"hx/type": "t", "hx/endpoints": []})
    assert x.value.status == 500


def test_entities_relations_and_types(net):
    assert [r.name for r in net.entities_latest("gadget").collect()] == ["Gizmo", "Sprocket", "Widget"] and net.entities("gadget").count == 3
    assert net.entity("n0")["name"] == "Widget" and net.entity("Gizmo")["id"] == "n1" and net.entity("g-1")["id"] == "n1" and net.entity_by_source("t", "g-1")["name"] == "Gizmo"
    with pytest.raises(Refused) as x:
        net.entity_by_source("t", None)
    assert x.value.status == 400
    assert net.entity_ensure({"name": "Widget", "type": "gadget"}).doc["id"] == "n0"
    assert net.entity_ensure({"id": "Q1", "name": "late", "type": "gadget"}).queued
    with pytest.raises(Refused) as x:
        net.entity_ensure({"id": "9x", "name": "bad", "type": "gadget"})
    assert (x.value.layer, x.value.reason) == (4, "non-canonical-id") and [q["disposition"] for q in net.queue] == ["queue", "reject"]
    rows, ends = net.relations(type="uses", hydrate=True)
    assert ids(rows) == ["rel|n0|uses|n2||"] and sorted(ids(ends)) == ["n0", "n2"]
    with pytest.raises(Refused):
        net.relation_upsert({"type": "uses", "from": "Widget", "to": "nobody"})
    with pytest.raises(Refused) as x:
        net.relations_batch([{"type": "uses", "src": "n0", "dst": "n1"}, {"type": "uses", "src": "n0", "dst": "gone"}])
    assert x.value.context == {"missing": ["gone"]} and net.relations(type="uses")[0].count() == 1
    net.relations_batch([{"type": "kit/uses", "src": "n0", "dst": "n1"}] * 2)
    assert net.relations(src="n0")[0].count() == 2
    net.types_parent("entity", "gadget", ":thing")
    net.types_merge("entity", "gadget", [":gizmo"])
    t = {(r.kind, r.type): (r.parent, r.aliases) for r in net.types().collect()}
    assert t[("entity", "gadget")] == ("thing", ["gizmo"]) and t[("relation", "kit/uses")][0] == "kit" and ("relation", "kit") in t
    asked = [{"kind": "entity", "type": "gadget"}, {"kind": "hyperedge", "type": "test/edge", "endpoint_types": []}, {"kind": "hyperedge", "type": "test/edge", "endpoint_types": ["left-kind"]}, {"kind": "what"}]
    assert [r.inhabited for r in net.inhabited(asked).collect()] == [True, True, False, False]
    assert net.retract([{"table": "entities", "id": "Q1"}, {"table": "entities", "id": "Q1"}]) == 1
    with pytest.raises(Refused):
        net.retract([{"table": "relations", "id": "x"}])
    assert net.health(deep=True)["tables"]["entities"] == 5


def test_memory_projection(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path), Clock()))
    for k in (1, 2):
        e.evidence_append({"id": f"m{k}", "type": "memory", "claim-type": "x", "author": "t", "body": {"hook": f"h{k}", "full-body": "long"}})
    put = lambda k, *ends, **more: e.hyperedge_upsert({"hx/id": f"hx:m{k}", "hx/type": "memory/assert", "hx/endpoints": [f"m{k}", *ends], "hx/props": {"roles": {"entry": f"m{k}"}}} | more)
    put(1, "pattern/a", "pattern/b")
    put(2, "pattern/a")
    put(3, "pattern/a")  # no such entry

    def counts(*ends, **basis):
        got = e.memory_projection(list(ends), **basis).collect()
        return [sum(r.endpoint == x and r.entry_id is not None for r in got) for x in ends]

    assert counts("pattern/a", "pattern/b", "absent") == [2, 1, 0]
    assert {r.hook for r in e.memory_projection(["pattern/a"]).collect()} == {"h1", "h2"}
    then = e.store.clock()
    put(1, "pattern/a", "pattern/c")
    assert counts("pattern/a", "pattern/b", "pattern/c") == [2, 0, 1]
    assert counts("pattern/a", "pattern/b", "pattern/c", as_of=then.isoformat(), system_as_of=then.isoformat()) == [2, 1, 0]
    e.retract([{"table": "hyperedges", "id": "hx:m2"}])
    assert counts("pattern/a", "pattern/c") == [1, 1]
    with pytest.raises(BadRequest):
        e.memory_projection([f"p{k}" for k in range(21)])


def test_bitemporal_reads(spark, tmp_path):
    e = Engine(Store(spark, str(tmp_path), Clock()))
    t1, t2 = NOW - timedelta(seconds=120), NOW - timedelta(seconds=60)
    put = lambda state, at: e.hyperedge_upsert({"hx/id": "x", "hx/type": "t", "hx/endpoints": ["a"], "hx/props": {"repo": state}}, valid_from=at)
    put("current", t1)
    put("superseded", t2)
    assert e.hyperedge("x", as_of=t1 + timedelta(seconds=1))["repo"] == "current" and e.hyperedge("x")["repo"] == "superseded"
    put("late", t1)  # written last, valid from before: it supersedes
    assert e.hyperedge("x")["repo"] == "late" and e.hyperedge("x", system_as_of=NOW + timedelta(seconds=2))["repo"] == "superseded"
    e.hyperedge_upsert({"op": "retract", "hx/id": "x"}, valid_from=t2)
    with pytest.raises(NotFound):
        e.hyperedge("x")
    assert e.hyperedge("x", as_of=t1 + timedelta(seconds=1))["repo"] == "late"
    with pytest.raises(ValueError):
        e.hyperedge("x", as_of="not-an-instant")
    e.store.compact()
    e.store.erase("hyperedges", spark.createDataFrame([("x",)], "id string"))
    assert e.store.log("hyperedges").count() == 0


def test_names_and_instants():
    assert names.tag_names([":a/b", "a/b", ":c", ":code/v05/calls"]) == ["b", "a/b", "c", "v05/calls"]
    assert names.parse_tags("a,, b,") == ["a", " b"] and names.canonical(":x") == "x" and names.canonical(" ") is None
    assert names.instant("1720000000000") == names.instant(1720000000000) == names.instant("2024-07-03T09:46:40Z") and names.instant("2026-07-04T17:54:11.277370618Z").microsecond == 277370
    assert [names.memory_limit(x) for x in (None, 0, 7, 500)] == [20, 20, 7, 100]
