"""Sources over HTTP against a small server, and ingest with rescue and read-back."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quillstone.operators import ingest
from quillstone.sources import remote
from quillstone.sources.store import Store
from test_api import Clock

CENSUS = {"a/b": "{:type \"a/b\" :kind :hyperedge :count 2}", "dead": "{:kind :hyperedge :count 0}", "gadget": "{:kind :entity :count 9}"}


class Served(BaseHTTPRequestHandler):
    flaky = []

    def answer(self, text, kind="application/edn", status=200):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(text.encode())

    def do_GET(self):
        at, q = urlparse(self.path), parse_qs(urlparse(self.path).query)
        if at.path.endswith("/census"):
            t = q["type"][0]
            if t == "flaky" and not self.flaky:
                self.flaky.append(1)
                return self.answer("busy", status=503)
            return self.answer("no", status=500) if t == "down" else self.answer(CENSUS.get(t, "{:kind :hyperedge :count 1}"))
        if at.path.endswith("/hyperedges"):
            docs = [{"id": f"{q['type'][0]}-{k}"} for k in range(int(q["limit"][0]))]
            return self.answer(json.dumps({"hyperedges": docs}), "application/json")
        if at.path.endswith("/sessions"):
            return self.answer('{:sessions [{:session-id "one (1)" :count 1} {:session-id "gone" :count 3} {:session-id nil :count 2}]}')
        if at.path.endswith("/evidence"):
            return self.answer("no", status=500) if q["session-id"] == ["gone"] else self.answer('{:entries [{:evidence/id "e" :t ::x/y}]}')
        return self.answer("{:types [{:id :a} {:id :b}]}")

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.answer('{:ok? true :snapshot/file "/snap.edn"}' if body["scope"] == "latest" else "{:ok? false}")

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def base():
    server = HTTPServer(("127.0.0.1", 0), Served)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_a_census_that_fails_is_unknown_and_not_zero(spark, base):
    got = {r.type: (r.kind, r["count"], r.status) for r in remote.census(spark, base, ["a/b", "dead", "gadget", "down", "flaky", "a/b"]).collect()}
    assert got == {"a/b": ("hyperedge", 2, "ok"), "dead": ("hyperedge", 0, "inactive"), "gadget": ("entity", 9, "inactive"), "down": (None, None, "failed"), "flaky": ("hyperedge", 1, "ok")}
    docs, census = remote.hyperedges(spark, base, ["a/b", "down", "dead"])
    assert sorted(json.loads(r.doc)["id"] for r in docs.collect()) == ["a/b-0", "a/b-1"] and census.where("status = 'failed'").first().type == "down"


def test_catalogue_evidence_and_snapshots(spark, base):
    assert [json.loads(r.doc) for r in remote.catalogue(spark, base).orderBy("ordinal").collect()] == [{"id": ":a"}, {"id": ":b"}]
    got = {r.name: (r.doc and json.loads(r.doc), r.error) for r in remote.evidence(spark, base).collect()}
    assert got["one (1)"] == ({"evidence/id": "e", "t": ":x/y"}, None) and got["gone"][0] is None and "500" in got["gone"][1] and len(got) == 2
    assert remote.snapshot(base, "latest") == "/snap.edn"
    with pytest.raises(RuntimeError):
        remote.snapshot(base, "all")


def test_rescue_ladder():
    nil = {"xt/id": "a", ":v": [1, None], ":m": {":k": [2]}}
    assert ingest.rescue({"xt/id": "a", ":n": None}, ingest.storable)[0] == "ok"
    rung, made = ingest.rescue(nil, ingest.storable)
    assert rung == "rescued-1" and made[":v"] == "[1, null]" and made[":m"] == {":k": [2]}
    flat = lambda d: not any(isinstance(v, (dict, list)) for v in d.values())
    rung, made = ingest.rescue(nil, flat)
    assert rung == "rescued-2" and made[":m"] == '{":k": [2]}' and ingest.rescue(nil, lambda d: 1 / 0) == ("failed", None)


def test_ingest_reads_back_and_repairs(spark, tmp_path):
    docs = [
        {"entity/id": "n1", "entity/name": "Widget", "type": "gadget"}, {"evidence/id": "e1", "evidence/type": "note", "claim-type": "x", "author": "a", "at": "2026", "tags": ["t", None]},
        {"what": 1}, {"xt/id": "m1", "what": {"deep": [1, None]}},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")

    class Dropping(Store):
        """Loses the entities of its first commit without a word."""

        lost = False

        def commit(self, frames, **how):
            if not self.lost and "entities" in frames:
                self.lost = True
                frames = {k: v for k, v in frames.items() if k != "entities"}
            return super().commit(frames, **how)

    store = Dropping(spark, str(tmp_path / "s"), Clock())
    got = {r.id: (r.tbl, r.status) for r in ingest.ingest_verified(store, df).collect()}
    assert got == {"n1": ("entities", "ok"), "e1": ("evidence", "rescued-1"), "m1": ("misc", "rescued-1"), None: ("misc", "failed")}
    assert store.table("entities").first().name == "Widget" and store.table("evidence").first().type == "note" and "what" in store.table("misc").first().body
    got = {r.tbl: (r.documents, r.stored, r.rescued, r.unstored) for r in ingest.summary(ingest.ingest_verified(store, df)).collect()}
    assert got == {"entities": (1, 1, 0, 0), "evidence": (1, 1, 1, 0), "misc": (2, 1, 1, 1)}
    store = Dropping(spark, str(tmp_path / "t"), Clock())
    assert {r.id: r.status for r in ingest.ingest_verified(store, df, attempts=1).collect()}["n1"] == "lost"
