"""The served surface: one method a route, over a store.  Refusals are exceptions that carry a status."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions import names
from .functions.errors import BadRequest, NotFound, Refused
from .operators import corpus, evidence as ev, graph, ingest, memory, text
from .sources.store import FEW, VIEWS, Conflict, Store


def _prop(props: dict | None, key: str):
    """A property by keyword or string key."""
    return None if not isinstance(props, dict) else props.get(f":{key}", props.get(key))


@dataclass
class Written:
    doc: dict
    no_op: bool = False
    queued: bool = False


class Engine:
    """``penholders`` may write (None: all may); ``models`` gives entity types their id pattern and queue."""

    def __init__(self, store: Store, penholders: set[str] | None = None, models: dict[str, dict] | None = None):
        self.store, self.penholders, self.models = store, penholders, models or {}
        self.spark = store.spark

    @property
    def queue(self) -> list[dict]:
        """What the gates have queued or rejected, in order; kept in the store."""
        return [r.asDict() for r in self.store.log("gate-queue").orderBy("at", "id").collect()]

    # helpers

    def _ids(self, table: str, wanted: list[str]) -> set[str]:
        some = [w for w in wanted if w]
        return {r.id for r in self.store.table(table).where(F.col("id").isin(some)).select("id").collect()} if some else set()

    def _one(self, rows: DataFrame) -> dict | None:
        got = rows.take(1)
        return got[0].asDict(recursive=True) if got else None

    def _types(self, kind: str, *types: str) -> dict[str, DataFrame]:
        """Types and their parents, the namespaces, where they are new: a frame to commit with what has them."""
        found = {}
        for t in types:
            space = t.partition("/")[0] if "/" in t else None
            found[t] = space
            if space:
                found.setdefault(space, None)
        known = self._ids("type-catalog", [f"type|{kind}|{t}" for t in found])
        new = [("put", {"id": i, "kind": kind, "type": t, "parent": p, "aliases": []}) for t, p in found.items() if (i := f"type|{kind}|{t}") not in known]
        return {"type-catalog": self.store.ops("type-catalog", new)} if new else {}

    def _verified(self, table: str, ids: list[str], there: bool) -> None:
        """Read back what was written."""
        got = self._ids(table, ids)
        wrong = sorted(set(ids) - got if there else got)
        if wrong:
            raise Refused(2, "read-back-failed", table=table, ids=wrong)

    def _judged(self, write):
        """Judge and commit on one basis; where another writer came between, judge again."""
        while True:
            try:
                return write(self.store.version)
            except Conflict:
                continue

    def _indexed(self, entries: DataFrame) -> dict[str, DataFrame]:
        posts, docs = text.index(entries.select("id", text.body_text(F.col("body")).alias("text")))
        return {"postings": posts, "text-docs": docs}

    # health

    def health(self, deep: bool = False) -> dict:
        return {"status": "ok"} | ({"tables": {t: self.store.table(t).count() for t in VIEWS}} if deep else {})

    # evidence

    def evidence_append(self, doc: dict, penholder: str | None = None) -> Written:
        ingest.allowed(penholder, self.penholders)
        entry = ingest.build_evidence(doc, self.store.clock())

        def write(base: int) -> Written:
            known = self._ids("evidence", [entry["in_reply_to"], entry["fork_of"], entry["id"]])
            for key, reason in (("in_reply_to", "reply-not-found"), ("fork_of", "fork-not-found")):
                if entry[key] and entry[key] not in known:
                    raise Refused(1, reason, id=entry[key])
            if entry["id"] in known:
                raise Refused(1, "duplicate-id", id=entry["id"])
            rows = self.store.ops("evidence", [("put", entry)])
            self.store.commit({"evidence": rows} | self._indexed(rows), base=base)
            return Written(entry)

        return self._judged(write)

    def evidence_append_batch(self, batch: DataFrame, order: str = "nth") -> DataFrame:
        """Append a DataFrame; the status of every row comes back, and those with 201 are in the store, indexed, in one commit."""
        from .sources.scratch import save

        def write(base: int) -> DataFrame:
            judged = save(ingest.append_guard(batch, self.store.table("evidence"), order), "judged")
            rows = self.store.puts("evidence", judged.where("status = 201").drop("status", "reason", order))
            self.store.commit({"evidence": rows} | self._indexed(rows), base=base)
            return judged.select("id", "status", "reason")

        return self._judged(write)

    def evidence(self, ident: str) -> dict:
        got = self._one(self.store.table("evidence").where(F.col("id") == ident))
        if got is None:
            raise NotFound(id=ident)
        return got

    def evidence_page(self, limit=None, cursor_at: str | None = None, cursor_id: str | None = None, tags: str | None = None, include_ephemeral=None, **filters) -> ev.Page:
        """``whole=False`` gives compact entries."""
        cursor = (cursor_at, cursor_id) if cursor_at and cursor_id else None
        return ev.page(self.store.table("evidence"), limit, cursor, tags=names.parse_tags(tags), include_ephemeral=str(include_ephemeral).lower() != "false", **filters)

    def evidence_count(self, tags: str | None = None, include_ephemeral=None, **filters) -> int:
        return ev.count(self.store.table("evidence"), tags=names.parse_tags(tags), include_ephemeral=str(include_ephemeral).lower() != "false", **filters).first()[0]

    def evidence_sessions(self, limit=None, since: str | None = None, author: str | None = None) -> tuple[DataFrame, DataFrame]:
        return ev.sessions_page(self.store.table("evidence"), limit, since=since, author=author)

    def evidence_chain(self, ident: str) -> DataFrame:
        return ev.chain(self.store.table("evidence"), ident)

    def text_matches(self, q: str, **filters) -> DataFrame:
        """Every entry that matches, with its score, from the index: no text is read but those of the entries that match."""
        if not (q or "").strip():
            raise BadRequest("blank-query")
        ranked = text.search_index(self.store.log("postings"), self.store.log("text-docs"), q, None)
        return ev.select(self.store.table("evidence"), **filters).join(ranked, "id")

    def text_search(self, q: str, limit=None, **filters) -> DataFrame:
        """The best entries in order of rank, up to the route's limit; ``text_matches`` has them all."""
        return self.text_matches(q, **filters).orderBy("score", "id").limit(names.limit(limit, 100))

    def text_stats(self) -> DataFrame:
        return text.index_stats(self.store.table("evidence"), self.store.log("text-docs"))

    def text_catch_up(self) -> int:
        """Index the entries that came into the store past the appends; their number."""

        def write(base: int) -> int:
            from .sources.scratch import save

            late, done = self.store.table("evidence").select("id", "body"), self.store.folders("text-docs")
            if done:  # bodies go to few ids, or meet them
                new = save(late.select("id").join(self.store.read("text-docs", done), "id", "left_anti"), "late")
                late = late.join(F.broadcast(new) if new.count() <= FEW else new, "id", "left_semi")
            n = late.count()
            if n:
                self.store.commit(self._indexed(late), base=base)
            return n

        return self._judged(write)

    def patterns_activation(self, since: str | None = None, limit: int | None = None) -> DataFrame:
        return corpus.activations(self.store.table("evidence"), since, limit)

    # hyperedges

    def hyperedge_upsert(self, doc: dict, penholder: str | None = None, valid_from=None) -> Written:
        ingest.allowed(penholder, self.penholders)
        get = lambda k: ingest.given(doc, k, "hx")
        valid_from = names.instant(get("valid-time") if valid_from is None else valid_from)
        kind, ends = names.canonical(get("type")), [str(e) for e in get("endpoints") or []]
        ident = get("id") or (f"hx:{kind}:{'.'.join(sorted(ends))}" if kind and ends else None)
        if doc.get("op") in ("retract", ":retract"):
            if ident is None:
                raise Refused(2, "id-or-type-and-endpoints-required")
            self.store.write("hyperedges", [("delete", {"id": ident})], valid_from)
            return Written({"id": ident})
        if not kind or not ends:
            raise Refused(2, "type-and-endpoints-required")
        props = get("props")
        stamp = _prop(props, "timestamp")
        entry = _prop(_prop(props, "roles"), "entry")
        edge = {
            "id": ident, "type": kind, "endpoints": ends, "ends": [{"entity_id": e} for e in ends], "labels": get("labels"), "props": None if props is None else json.dumps(props, ensure_ascii=False, sort_keys=True),
            "repo": _prop(props, "repo"), "source_file": _prop(props, "source-file"), "timestamp": float(stamp) if isinstance(stamp, (int, float)) else None, "entry": entry if isinstance(entry, str) else None,
        }
        if valid_from is None:
            old = self._one(self.store.table("hyperedges").where(F.col("id") == edge["id"]))
            if old and all(v is None or old.get(k) == v for k, v in edge.items()):
                return Written(edge, no_op=True)
        self.store.write("hyperedges", [("put", edge)], valid_from)
        return Written(edge)

    def hyperedge(self, ident: str, as_of=None, system_as_of=None) -> dict:
        got = self._one(self.store.table("hyperedges", names.instant(as_of), names.instant(system_as_of)).where(F.col("id") == ident))
        if got is None:
            raise NotFound(id=ident)
        return got

    def hyperedges(self, as_of=None, system_as_of=None, **query) -> graph.Listing:
        near = None
        if query.get("end") is not None:
            near = self._at_any(self._targets(query["end"]))
        elif query.get("type") is not None:
            near = F.col("type") == names.canonical(query["type"])
        basis = names.instant(as_of), names.instant(system_as_of)
        return graph.hyperedges(self.store.table("hyperedges", *basis, near), self.store.table("entities"), **query)

    def _targets(self, end: str) -> list[str]:
        """An end, which is searched by the entity's name too if it is a UUID."""
        found = self._one(self.store.table("entities").where(F.col("id") == end)) if re.fullmatch(names.UUID, end) else None
        return list(dict.fromkeys([end] + ([found["name"]] if found and found["name"] else [])))

    def _at_any(self, targets: list[str]):
        return F.arrays_overlap("endpoints", F.array(*[F.lit(t) for t in targets]))

    def edges_at(self, end: str, type: str | None = None, as_of=None, system_as_of=None) -> DataFrame:
        """Every edge at an end; ``hyperedges`` lists the first ones by id, up to the route's limit."""
        targets = self._targets(end)
        return graph.with_endpoint(self.store.table("hyperedges", names.instant(as_of), names.instant(system_as_of), self._at_any(targets)), *targets, type=type)

    # entities

    def entity_ensure(self, doc: dict, penholder: str | None = None) -> Written:
        """Upsert by id, else by name (an entity of the same type first, then the least id), else under a new id."""
        ingest.allowed(penholder, self.penholders)
        get = lambda k: ingest.given(doc, k, "entity")
        name, kind = get("name"), names.canonical(get("type"))
        if not name or not kind:
            raise BadRequest("name-and-type-required")
        ident = get("id")
        if not ident:
            found = self.store.table("entities", where=F.col("name") == name).orderBy(F.col("type") != kind, "id").select("id").first()
            ident = found.id if found else str(uuid.uuid4())
        queued, noted = False, {}
        if kind in self.models:
            model = self.models[kind]
            verdict = self.spark.range(1).select(ingest.classify_id(F.lit(ident), model.get("id_pattern"), model.get("queue", []))).first()[0]
            if verdict != "accept":
                row = (ident, kind, verdict, self.store.clock())
                noted = {"gate-queue": self.spark.createDataFrame([row], "id string, type string, disposition string, at timestamp")}
            if verdict == "reject":
                self.store.commit(noted)
                raise Refused(4, "non-canonical-id", id=ident, type=kind, expected=model.get("id_pattern"))
            queued = verdict == "queue"
        props = get("props")
        entity = {"id": ident, "name": name, "type": kind, "external_id": get("external-id"), "source": get("source"), "props": None if props is None else json.dumps(props, ensure_ascii=False, sort_keys=True)}
        self.store.commit({"entities": self.store.ops("entities", [("put", entity)])} | self._types("entity", kind) | noted)
        return Written(entity, queued=queued)

    def entity(self, key: str) -> dict:
        got = self._one(graph.fetch_entity(self.store.table("entities", where=(F.col("id") == key) | (F.col("name") == key) | (F.col("external_id") == key)), key))
        if got is None:
            raise NotFound(key=key)
        return got

    def entity_by_source(self, source: str | None, external_id: str | None) -> dict:
        return self._one(graph.by_external(self.store.table("entities", where=F.col("external_id") == external_id), source, external_id))

    def entities(self, type: str | None = None, limit=None) -> graph.Listing:
        if not type:
            raise BadRequest("type-required")
        rows = graph.entities_of(self.store.table("entities", where=F.col("type") == names.canonical(type)), type, names.limit(limit))
        return graph.Listing(rows, rows.count())

    def entities_latest(self, type: str | None = None, limit=None) -> DataFrame:
        if not type:
            raise Refused(4, "type-required")
        sigils = self.store.table("relations") if names.canonical(type) == "pattern/library" else None
        return graph.latest_by_name(self.store.table("entities", where=F.col("type") == names.canonical(type)), type, names.limit(limit), sigils)

    def retract(self, documents: list[dict], penholder: str | None = None) -> int:
        """Retract documents {table, id} of entities and hyperedges: all in one commit or none, each once, and read back."""
        ingest.allowed(penholder, self.penholders)
        if not documents or any(d.get("table") not in ("entities", "hyperedges") or not d.get("id") for d in documents):
            raise Refused(4, "invalid-retraction")
        once = list(dict.fromkeys((d["table"], d["id"]) for d in documents))
        by = {table: [i for t, i in once if t == table] for table in dict.fromkeys(t for t, _ in once)}
        self.store.commit({table: self.store.ops(table, [("delete", {"id": i}) for i in ids]) for table, ids in by.items()})
        for table, ids in by.items():
            self._verified(table, ids, False)
        return len(once)

    # relations

    def _relation(self, doc: dict, src: str, dst: str) -> dict:
        get = lambda k: ingest.given(doc, k, "relation")
        kind = names.canonical(get("type"))
        if not kind:
            raise BadRequest("relation-type-required")
        note, order, props = get("note"), get("order"), get("props")
        ident = get("id") or f"rel|{src}|{kind}|{dst}|{'' if note is None else note}|{'' if order is None else order}"
        return {"id": ident, "type": kind, "src": src, "dst": dst, "note": note, "order": None if order is None else str(order), "props": None if props is None else json.dumps(props, ensure_ascii=False, sort_keys=True)}

    def _resolve(self, keys: list) -> dict:
        flat = [k if isinstance(k, str) else next((k[x] for x in ("entity/id", "id", "entity/name", "name") if k.get(x)), "") for k in keys]
        wanted = self.spark.createDataFrame([(k,) for k in dict.fromkeys(flat)], "key string")
        found = {r.key: r.resolved for r in graph.resolve_ends(wanted, self.store.table("entities")).collect()}
        return dict(zip(range(len(keys)), (found[k] for k in flat)))

    def relation_upsert(self, doc: dict, penholder: str | None = None) -> Written:
        ingest.allowed(penholder, self.penholders)
        ends = [ingest.given(doc, k, "relation") or ingest.given(doc, other, "relation") for k, other in (("src", "from"), ("dst", "to"))]
        got = self._resolve(ends) if all(ends) else {0: None}
        if None in got.values():
            raise Refused(2, "endpoint-not-found", endpoints=ends)
        rel = self._relation(doc, got[0], got[1])
        self.store.commit({"relations": self.store.ops("relations", [("put", rel)])} | self._types("relation", rel["type"]))
        return Written(rel)

    def relations_batch(self, docs: list[dict], penholder: str | None = None) -> list[dict]:
        """All relations or none, in one commit with their types, and read back: every endpoint must exist."""
        ingest.allowed(penholder, self.penholders)
        rels = [self._relation(d, ingest.given(d, "src", "relation"), ingest.given(d, "dst", "relation")) for d in docs]
        ends, last = {r[k] for r in rels for k in ("src", "dst")}, {r["id"]: r for r in rels}

        def write(base: int) -> list[dict]:
            missing = sorted(str(e) for e in ends - self._ids("entities", list(ends)))
            if missing:
                raise Refused(2, "missing-endpoints", missing=missing)
            if rels:
                self.store.commit({"relations": self.store.ops("relations", [("put", r) for r in last.values()])} | self._types("relation", *[r["type"] for r in rels]), base=base)
                self._verified("relations", list(last), True)
            return rels

        return self._judged(write)

    def relations(self, type: str | None = None, types: list[str] | None = None, src: str | None = None, dst: str | None = None, limit=None, hydrate: bool = False) -> tuple[DataFrame, DataFrame | None]:
        near = next((F.col(c) == v for c, v in (("src", src), ("dst", dst), ("type", names.canonical(type))) if v), None)
        rows = graph.relations_of(self.store.table("relations", where=near), type, types, src, dst, names.limit(limit))
        return rows, graph.hydrate(rows, self.store.table("entities")) if hydrate else None

    # graph

    def inhabited(self, bindings: list[dict]) -> DataFrame:
        if not isinstance(bindings, list):
            raise BadRequest("bindings-required")
        return graph.inhabited(bindings, self.store.table("entities"), self.store.table("hyperedges"))

    def census(self, type: str | None = None, entity_type: str | None = None) -> dict:
        if not (type or entity_type):
            raise BadRequest("type-or-entity-type-required")
        kind, table = ("hyperedge", "hyperedges") if type else ("entity", "entities")
        rows = self.store.table(table, where=F.col("type") == names.canonical(type or entity_type))
        return {"type": type or entity_type, "kind": kind, "count": rows.count()}

    def types(self) -> DataFrame:
        return self.store.table("type-catalog").where("kind is not null").orderBy(F.concat_ws("|", "kind", names.rendered(F.col("type"))))

    def types_parent(self, kind: str, type: str, parent: str | None, penholder: str | None = None) -> Written:
        return self._retype(kind, type, penholder, parent=names.canonical(parent) if parent else None)

    def types_merge(self, kind: str, type: str, aliases: list[str], penholder: str | None = None) -> Written:
        if not isinstance(aliases, (list, tuple)):
            raise BadRequest("aliases-must-be-a-sequence")
        return self._retype(kind, type, penholder, aliases=[names.canonical(a) for a in aliases])

    def _retype(self, kind: str, type: str, penholder: str | None, **change) -> Written:
        ingest.allowed(penholder, self.penholders)
        t = names.canonical(type)
        ident = f"type|{kind}|{t}"
        old = self._one(self.store.table("type-catalog").where(F.col("id") == ident)) or {"id": ident, "kind": kind, "type": t, "parent": None, "aliases": []}
        new = old | change
        self.store.write("type-catalog", [("put", new)])
        return Written(new)

    # memory

    def memory_search(self, type: str | None = None, author: str | None = None, since: str | None = None, tags: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
        n, wanted = names.memory_limit(limit), names.parse_tags(tags)
        if text:
            rows = self.text_search(text, max(n, 24), author=author, since=since)
            return ev.select(rows, type=type, tags=[t.partition("/")[2] or t for t in wanted]).orderBy("score", "id").limit(n).withColumn("frame", F.lit(memory.FRAME))
        return memory.search(self.store.table("evidence"), type, author, since, wanted, n).withColumn("frame", F.lit(memory.FRAME))

    def memory_refresh(self) -> int:
        """Bring the kept projection up to the last commit and return its revision.  Only edges that were written since, and
        those whose entry was, are joined again."""

        def write(base: int) -> int:
            rows, changed = self._components(base)
            if changed:
                from .sources.scratch import save

                rows = save(rows, "projection")
                memory.within(rows)
                mark = self.store.log("hyperedges").agg(F.max("system_time")).first()[0]
                self.store.commit({"memory-projection": rows}, base=base, replace=["memory-projection"], notes={"projection": {"revision": base, "watermark": str(mark)}})
            return base

        return self._judged(write)

    def projection_state(self) -> dict:
        """Revision and watermark of the kept projection, and whether nothing was written to its tables since."""
        note = self.store.state()[1]["notes"].get("projection", {"revision": 0, "watermark": None})
        late = any(self.store.folders(t, note["revision"]) for t in ("hyperedges", "evidence"))
        return note | {"fresh": not late}

    def _components(self, base: int) -> tuple[DataFrame, bool]:
        """The projection as of now: kept rows, but for edges touched since their revision, which are joined again."""
        note = self.projection_state()
        kept = self.store.log("memory-projection")
        if note["fresh"]:
            return kept, False
        edges, entries = self.store.table("hyperedges", where=F.col("type") == "memory/assert"), self.store.table("evidence")
        if not note["revision"]:
            return memory.components(edges, entries).select(*kept.columns), True
        wrote = self.store.read("hyperedges", self.store.folders("hyperedges", note["revision"])).select("id")
        came = self.store.read("evidence", self.store.folders("evidence", note["revision"])).select(F.col("id").alias("entry"))
        touched = wrote.union(edges.join(came, "entry", "left_semi").select("id")).distinct()
        again = memory.components(edges.join(touched, "id", "left_semi"), entries).select(*kept.columns)
        return kept.join(touched, "id", "left_anti").unionByName(again), True

    def memory_projection(self, endpoints: list[str], limit: int | None = None, as_of=None, system_as_of=None) -> DataFrame:
        if as_of is None and system_as_of is None:
            rows, _ = self._components(self.store.version)
            return memory.project(memory.within(rows), endpoints, limit)
        edges = self.store.table("hyperedges", names.instant(as_of), names.instant(system_as_of), F.col("type") == "memory/assert")
        return memory.project_as_of(memory.fitting(edges, endpoints, limit), self.store.table("evidence"), endpoints, limit)
