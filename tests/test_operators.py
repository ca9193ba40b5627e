"""Sources, text, verification, streaming and ingest rules."""

import io
import json
from itertools import product

import pytest
from pyspark.sql import functions as F

from quillstone.operators import corpus, evidence as ev, graph, ingest, temporal, text, verify
from quillstone.sources import edn
from quillstone.streaming import incremental

EDN = """{:evidence [{:evidence/id "a", :evidence/tags [:x/y "x/y" :z] ; a comment
  :evidence/body {"k" 1.5, :n nil, :s #{3 1 2}} :evidence/at #inst "2026-07-04T17:54:11.277370618Z" :c \\newline #_ :gone}
 {:evidence/id "b" :n -7N :q \\a :u #uuid "u-1" :o #my/tag [1]}]}"""


def test_edn_layouts_and_values():
    a, b = edn.documents(io.StringIO(EDN))
    assert a == {":evidence/id": "a", ":evidence/tags": [":x/y", "x/y", ":z"], ":evidence/body": {"k": 1.5, ":n": None, ":s": [1, 2, 3]}, ":evidence/at": "2026-07-04T17:54:11.277Z", ":c": "\n"}
    assert b == {":evidence/id": "b", ":n": -7, ":q": "a", ":u": "u-1", ":o": {"tag": "my/tag", "value": [1]}}
    assert list(edn.documents(io.StringIO("{:a 1}\n{:a 2} {:a 3}"))) == list(edn.documents(io.StringIO("[{:a 1} {:a 2}, {:a 3}]"))) == [{":a": k} for k in (1, 2, 3)]
    assert list(edn.documents(io.StringIO(""))) == [] and edn.sanitise('{::a "::b" :c \\: ::d/e}') == ('{:a "::b" :c \\: :d/e}', 2)
    for bad in ("[{:a 1}", '{:a "x}', "[{:a}]", "]"):
        with pytest.raises(edn.Malformed):
            list(edn.documents(io.StringIO(bad)))
    text_ = "x" * 70_000 + '"\n'
    assert list(edn.documents(io.StringIO("[" + edn.edn({":t": text_}) + "]"))) == [{":t": text_}]


def test_edn_source(spark, tmp_path):
    spark.dataSource.register(edn.EdnSource)
    (tmp_path / "one.edn").write_text(EDN)
    edn.write_edn(str(tmp_path / "two.edn"), iter([{":evidence/id": "c", ":t": [None, True, 2.5, ":k/w"]}]))
    got = [json.loads(r.doc) for r in spark.read.format("edn").load(str(tmp_path)).orderBy("file", "ordinal").collect()]
    assert [d[":evidence/id"] for d in got] == ["a", "b", "c"] and got[2][":t"] == [None, True, 2.5, ":k/w"]


def test_seed_answers(spark):
    """A hundred edges over thirty endpoints, with known memberships."""
    kinds = ["code/calls", "code/mentions", "mission/depends", "evidence/links", "social/tags"]
    pool = [f"e-{k + 1}" for k in range(30)]
    rows = [(i, kinds[i % 5], list(dict.fromkeys([pool[i % 30], pool[2 * i % 30]] + ([pool[3 * i % 30]] if i % 2 == 0 else [])))) for i in range(100)]
    edges = spark.createDataFrame(rows, "id int, type string, endpoints array<string>")
    assert graph.with_endpoint(edges, "e-7").count() == sum("e-7" in r[2] for r in rows)
    assert graph.by_type(edges, "code/calls").count() == 20 and graph.window(graph.by_type(edges, "code/calls"), 10).count() == 10
    tags = [["psr"], ["pur"], ["par"], ["proof-path"], ["psr", "proof-path"]]
    log = spark.createDataFrame([(1000 + i, tags[i % 5]) for i in range(30)], "id int, tags array<string>")
    assert log.where(ev.tags_any(["proof-path"])).count() == 12


def test_string_time_is_not_chronology(spark):
    log = spark.createDataFrame([("a", "2026-07-10T10:00:00.5Z"), ("b", "2026-07-10T10:00:00Z")], "id string, at string")
    assert [r.id for r in ev.newest(log, 5).collect()] == ["b", "a"]


def test_roots_of_long_threads_and_cycles(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(150)] + [("x", "y"), ("y", "z"), ("z", "y"), ("d", "gone"), ("s", "s")]
    got = {r.id: (r.root, r.depth) for r in ev.roots(spark.createDataFrame(rows, "id string, in_reply_to string")).collect()}
    assert all(got[f"n{k}"] == ("n0", k) for k in range(150)) and got["d"] == ("d", 0) and {got[k] for k in "xyzs"} == {(None, None)}


def test_as_of_takes_the_last_writing_that_covers(spark):
    rows = [("a", "put", 1, None, 1, 0, "x"), ("a", "put", 5, None, 2, 0, "y"), ("a", "put", 2, 4, 3, 0, "z"), ("a", "delete", 8, None, 4, 0, None), ("b", "put", 3, None, 1, 1, "p"), ("b", "put", 3, None, 1, 2, "q")]
    log = spark.createDataFrame(rows, "id string, op string, valid_from int, valid_to int, system_time int, ordinal int, state string")

    def brute(v, s):
        out = {}
        for i, op, lo, hi, t, n, state in sorted(rows, key=lambda r: (r[4], r[5])):
            if t <= s and lo <= v and (hi is None or v < hi):
                out[i] = (op, state)
        return {i: st for i, (op, st) in out.items() if op == "put"}

    for v, s in product(range(0, 10), range(0, 5)):
        if (v + s) % 3 == 0:
            assert {r.id: r.state for r in temporal.as_of(log, v, s).collect()} == brute(v, s)
    assert temporal.erase(log, log.where("id = 'a'")).count() == 2


def test_match_strings_and_tokenisers(spark):
    assert text.parse_match("a b AND c OR d-e") == [[["a"], ["b"], ["c"]], [["d", "e"]]] and text.parse_match("or") == [[["or"]]]
    t = spark.createDataFrame([("Éa-b C3 x é",), (None,)], "t string")
    got = t.select(text.word_tokens(F.col("t")).alias("w"), text.folded_tokens(F.col("t")).alias("f"), text.ascii_tokens(F.col("t")).alias("a")).collect()
    assert got[0].w == ["éa", "c3"] and got[0].f == ["ea", "b", "c3", "x", "e"] and got[0].a == ["a", "b", "c3", "x"]


def test_nearest_rank(spark):
    values = [5, 1, 1, 9, 7, 3, 3]
    got = corpus.nearest_rank(spark.createDataFrame([(v,) for v in values], "v int"), "v", [0.0, 0.5, 0.9, 1.0]).first()
    assert tuple(got) == tuple(sorted(values)[min(6, int(p * 7))] for p in (0, 0.5, 0.9, 1))


def test_canonical_documents():
    a = {"B/Key": 1, "b": None, "set": {3, 1}, "Nested": {"x": None, "Y": [None, 2]}}
    b = {"nested": {"y": [None, 2]}, "set": [1, 3], "B/key": 1}
    assert verify.checksum(a) == verify.checksum(b) != verify.checksum(b | {"z": 0}) and verify.fold_key("Ab/Cd") == "Ab/cd"


def test_documents_compared_by_key(spark):
    assert verify.compare_docs({"a": 1, "B": [1], "n": None, "x/y/z": 2}, {"a": 1, "b": [2], "extra": 5}) == {"missing": False, "keys": ["B"], "unverifiable": ["x/y/z"]}
    assert verify.compare_docs({"a": 1}, None)["missing"]
    rows = spark.createDataFrame([(1, '{"a": [1]}'), (2, "no json" * 99), (3, None)], "id int, doc string")
    got = {r.id: r for r in ingest.shape_log(rows, "id", "doc").collect()}
    assert got[1].kind == "OBJECT<a: ARRAY<BIGINT>>" and len(got[2].preview) == 200 and got[3].kind == "null"


def test_normalising_documents():
    assert ingest.stringify({":a": {"s": 1}, ":b": [{":c": 2}]}) == {":a": '{"s": 1}', ":b": [{":c": 2}]}
    assert ingest.denormalise({":repo": "r", ":x/repo": "q", ":x/file": "f", "plain": 1}) == {"prop/repo": "r", "prop/file": "f"}
    assert ingest.risky_nil({"a": [None]}) and not ingest.risky_nil({"a": [1]})
    assert ingest.ensure_id({"evidence/id": "e", "hx/id": "h"}) == "h" and ingest.route({"entity/id": "x"}) == "entities" and ingest.route({"who": 1}) == "misc"


def test_stream_applies_again_without_doubling(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one two two"), ("b", "two")], "id string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.apply(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), text.postings, str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    run()  # nothing new
    spark.createDataFrame([("a", "three")], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {tuple(r) for r in incremental.latest(spark, str(tmp_path / "out"), "id").collect()} == {("a", "three", 1), ("b", "two", 1)}


def test_activations(spark):
    body = json.dumps({"event": "context-retrieval", "query": "q" * 300, "results": [{"id": "p", "title": "P", "score": 0.5}, {"id": "r", "score": 1.0}]})
    log = spark.createDataFrame([("1", "2026-01-01", "a", "s", body), ("2", "2026-01-02", "a", "s", body), ("3", "2026-01-03", "a", "s", '{"event": "other"}')], "id string, at string, author string, session_id string, body string")
    got = corpus.activations(log, since="2026-01-02").collect()
    assert [(r.pattern, r["count"], r.avg_score, r.last_fired) for r in got] == [("p", 1, 0.5, "2026-01-02"), ("r", 1, 1.0, "2026-01-02")] and len(got[0].activations[0].query) == 240


def test_wire_formats():
    from quillstone.functions import wire

    row = {"id": "e1", "type": "claim", "tags": ["a/b"], "tag_names": ["b"], "subject": {"ref_type": "thread", "ref_id": "t1"}, "author": None, "body": "x: y"}
    doc = wire.public(row, "evidence")
    assert doc == {":evidence/id": "e1", ":evidence/type": ":claim", ":evidence/tags": [":a/b"], ":evidence/subject": {":ref/type": "thread", ":ref/id": "t1"}, ":evidence/body": "x: y"}
    kind, text_ = wire.render(doc)
    assert kind == "application/edn" and list(edn.documents(io.StringIO(f"[{text_}]"))) == [doc]
    kind, text_ = wire.render({":entries": [doc], ":types": [":claim"]}, "application/json, application/edn")
    assert kind == "application/json" and json.loads(text_) == {"entries": [{"evidence/id": "e1", "evidence/type": "claim", "evidence/tags": ["a/b"], "evidence/subject": {"ref/type": "thread", "ref/id": "t1"}, "evidence/body": "x: y"}], "types": [":claim"]}
    assert wire.render({}, "application/edn, application/json")[0] == wire.render({}, None)[0] == "application/edn"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_sanitising_as_it_is_read(block):
    whole = '; a ::comment\n{::k "a ::b \\" ::c" :c \\: ::d/e [::x ::y] "::" ::long-word-without-end} ; ::end'
    source = edn.Sanitised(io.StringIO(whole))
    parts = []
    while part := source.read(block):
        parts.append(part)
    assert ("".join(parts), source.count) == edn.sanitise(whole)


def test_edn_files_of_any_file_system(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.edn").write_text("[{::a %d} {:b \"x\"}]" % k)
    got = edn.read(spark, str(tmp_path), clean=True).orderBy("file", "ordinal").collect()
    assert [json.loads(r.doc) for r in got] == [d for k in range(5) for d in ({":a": k}, {":b": "x"})] and [r.ordinal for r in got] == [0, 1] * 5


def test_edn_written_by_partitions_reads_back(spark, tmp_path):
    docs = [{":id": f"d{k}", ":text": 'a "b"\n', ":tags": [":x/y", None]} for k in range(20)]
    edn.write(spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,)], "doc string").repartition(3), str(tmp_path / "out"))
    got = [json.loads(r.doc) for r in edn.read(spark, str(tmp_path / "out")).collect()]
    assert sorted(got, key=lambda d: d[":id"]) == sorted(docs, key=lambda d: d[":id"])


def test_nested_rows_are_canonical(spark):
    a = spark.createDataFrame([(1, {"Z": 1, "a": None}, [{"q": 2, "P": None}], [None, "x"])], "id int, M struct<Z: int, a: int>, v array<struct<q: int, P: int>>, t array<string>")
    b = spark.createDataFrame([([None, "x"], 1, [{"p": None, "Q": 2}], {"A": None, "z": 1})], "t array<string>, ID int, v array<struct<p: int, Q: int>>, m struct<A: int, z: int>")
    got = a.select(verify.canonical_json(a, a.columns)).first()[0]
    assert got == b.select(verify.canonical_json(b, b.columns)).first()[0] == '{"id":1,"m":{"z":1},"t":[null,"x"],"v":[{"q":2}]}'
