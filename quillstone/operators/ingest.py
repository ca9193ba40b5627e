"""Writes as batches: shape checks, gates, guards, stable ids, normalisation, routing."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names
from ..functions.errors import BadRequest, Refused

TABLES = {"hyperedge": "hyperedges", "evidence": "evidence", "entity": "entities", "relation": "relations", "doc": "docs", "lab-session": "lab-sessions", "type": "type-catalog"}
ID_KEYS = ("hx/id", "evidence/id", "entity/id", "relation/id", "doc/id", "lab/session-id", "type/id")
MARKS = dict(zip(ID_KEYS, TABLES.values()))


# one document


def given(doc: dict, key: str, space: str = "evidence"):
    """A namespaced key wins over the bare one."""
    return doc.get(f"{space}/{key}", doc.get(key))


def build_evidence(doc: dict, now: datetime | None = None, new_id=lambda: str(uuid.uuid4())) -> dict:
    """An entry from a request, with defaults; type, claim type and author are required, in this order."""
    out = {}
    for key in ("type", "claim-type", "author"):
        value = given(doc, key)
        value = names.canonical(value) if key != "author" else value
        if not value:
            raise BadRequest(f"evidence/{key} required")
        out[key.replace("-", "_")] = value
    tags = list(given(doc, "tags") or [])
    subject = given(doc, "subject") or {}
    body = given(doc, "body")
    out |= {
        "id": given(doc, "id") or new_id(), "at": given(doc, "at") or (now or datetime.now(timezone.utc)).isoformat().replace("+00:00", "Z"),
        "body": body if isinstance(body, str) else json.dumps({} if body is None else body, ensure_ascii=False), "tags": [names.canonical(t) for t in tags], "tag_names": names.tag_names(tags),
        "subject": {"ref_type": names.canonical(str(subject.get("ref/type"))), "ref_id": str(subject.get("ref/id"))} if subject else None,
        "pattern_id": names.canonical(given(doc, "pattern-id")), "session_id": given(doc, "session-id"), "in_reply_to": given(doc, "in-reply-to"), "fork_of": given(doc, "fork-of"),
        "conjecture": given(doc, "conjecture?"), "ephemeral": given(doc, "ephemeral?"),
    }
    return out


def ensure_id(doc: dict) -> str | None:
    """The document's own id, else the first typed id it has."""
    return doc.get("xt/id") or next((doc[k] for k in ID_KEYS if doc.get(k)), None)


def route(doc: dict) -> str:
    """The table a document belongs to."""
    return next((t for k, t in MARKS.items() if doc.get(k)), "misc")


def stringify(x):
    """Deep normalisation: maps with keys that aren't keywords (":k") become one string, others are walked."""
    if isinstance(x, dict):
        if any(not str(k).startswith(":") for k in x):
            return json.dumps(x, ensure_ascii=False, sort_keys=True)
        return {k: stringify(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [stringify(v) for v in x]
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def risky_nil(x) -> bool:
    """Whether a nil sits inside a vector or a nested map."""
    if isinstance(x, dict):
        return any(v is None or risky_nil(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return any(v is None or risky_nil(v) for v in x)
    return False


def without_nils(x, top: bool = True):
    """Vectors and nested maps that hold a nil as one string; nils of the document itself stay."""
    if isinstance(x, dict):
        if not top and risky_nil(x):
            return json.dumps(x, ensure_ascii=False, sort_keys=True)
        return {k: without_nils(v, False) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return json.dumps(x, ensure_ascii=False, sort_keys=True) if risky_nil(x) else [without_nils(v, False) for v in x]
    return x


def flattened(x: dict) -> dict:
    """Every collection of the document as one string."""
    return {k: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (dict, list, tuple)) else v for k, v in x.items()}


LADDER = (("ok", lambda d: d), ("rescued-1", without_nils), ("rescued-2", lambda d: flattened(without_nils(d))))


def rescue(doc: dict, accepts) -> tuple[str, dict | None]:
    """The first rung of the ladder whose document ``accepts`` takes (a refusal is False or raises), and that document;
    ``failed`` where none is."""
    for rung, change in LADDER:
        made = change(doc)
        try:
            if accepts(made) is not False:
                return rung, made
        except Exception:  # noqa: BLE001  whatever the store says, the next rung is tried
            continue
    return "failed", None


def storable(doc: dict) -> bool:
    """What the operation log takes: no nil inside a vector or nested map."""
    return bool(ensure_id(doc)) and not any(risky_nil(v) for v in doc.values())


def ingest_verified(store, docs: DataFrame, accepts=storable, attempts: int = 2) -> DataFrame:
    """Put documents (JSON strings in column ``doc``) into the tables they belong to, in one commit, read every id back and
    put again what isn't there; (id, tbl, status) with the rung of the ladder, ``failed``, or ``lost``.

    Documents are judged in Arrow batches by the executors; a document of no table goes to ``misc``."""
    from ..sources.scratch import save
    from ..sources.store import VIEWS

    def judge(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for text in b["doc"]:
                d = json.loads(text)
                rung, made = rescue(d, accepts)
                table = route(d)
                rows.append((ensure_id(d), table if table in VIEWS else "misc", rung, None if made is None else json.dumps(made, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["id", "tbl", "status", "body"])

    judged = save(docs.select("doc").mapInPandas(judge, "id string, tbl string, status string, body string"), "judged")
    todo = judged.where("body is not null")
    tables = [r.tbl for r in todo.select("tbl").distinct().collect()]  # one row a table
    for _ in range(attempts):
        frames = {t: store.puts(t, _typed(todo.where(F.col("tbl") == t), t)) for t in tables if not todo.where(F.col("tbl") == t).isEmpty()}
        if frames:
            store.commit(frames)
        there = None
        for t in tables:
            one = store.log(t).select("id", F.lit(t).alias("tbl"))
            there = one if there is None else there.union(one)
        todo = todo if there is None else save(todo.join(there.distinct(), ["id", "tbl"], "left_anti"), "absent")
        if todo.isEmpty():
            break
    lost = todo.select("id", "tbl", F.lit(True).alias("lost")).distinct()
    return judged.join(lost, ["id", "tbl"], "left").select("id", "tbl", F.when(F.col("lost"), "lost").otherwise(F.col("status")).alias("status"))


def summary(ingested: DataFrame) -> DataFrame:
    """(tbl, documents, stored, rescued, unstored) of what ``ingest_verified`` returns."""
    n = lambda c: F.count(F.when(c, 1))
    bad = F.col("status").isin("failed", "lost")
    return ingested.groupBy("tbl").agg(F.count("*").alias("documents"), n(~bad).alias("stored"), n(F.col("status").startswith("rescued")).alias("rescued"), n(bad).alias("unstored"))


def _typed(rows: DataFrame, table: str) -> DataFrame:
    """The view's columns of documents: a namespaced key wins over the bare one; names are written with hyphens there."""
    from pyspark.sql.types import ArrayType, StringType, StructType

    from ..sources.store import VIEWS

    space = next((k.partition("/")[0] for k, t in MARKS.items() if t == table), "")
    cols = [F.col("id")]
    for f in StructType.fromDDL(VIEWS[table]):
        if f.name == "id":
            continue
        if table in ("docs", "misc"):
            cols.append(F.col("body").alias(f.name))
            continue
        keys = [k.format(f.name.replace("_", "-")) for k in ("$['" + space + "/{}']", "$['{}']")]
        raw = F.coalesce(*[F.get_json_object("body", k) for k in keys])
        if isinstance(f.dataType, (ArrayType, StructType)):
            raw = F.from_json(raw, f.dataType)
        elif not isinstance(f.dataType, StringType):
            raw = raw.try_cast(f.dataType)
        cols.append(raw.alias(f.name))
    return rows.select(*cols)


def denormalise(props: dict) -> dict:
    """prop/<name> of every keyword key; an unqualified key beats a qualified one."""
    out = {}
    for k in sorted((k for k in props if str(k).startswith(":")), key=lambda k: "/" not in k):
        out["prop/" + re.sub("^[^/]+/", "", k[1:])] = props[k]
    return out


def shape_log(docs: DataFrame, id_col: str, json_col: str, chars: int = 200) -> DataFrame:
    """(id, kind, preview) of documents that belong to no table, for a side output."""
    kind = F.when(F.col(json_col).isNull(), "null").otherwise(F.schema_of_variant(F.try_parse_json(json_col)))
    return docs.select(F.col(id_col).alias("id"), F.substring(kind, 1, chars).alias("kind"), F.substring(json_col, 1, chars).alias("preview"))


def allowed(penholder: str | None, holders: set[str] | None) -> None:
    """Refuse a writer that isn't on the list (no list: all may write)."""
    if holders is not None and penholder not in holders:
        raise Refused(3, "penholder-not-authorized", penholder=penholder)


# batches


def classify_id(ident: Column, pattern: str | None, queue: list[str]) -> Column:
    """accept, queue or reject."""
    if pattern is None:
        return F.lit("accept")
    out = F.when(ident.rlike(pattern), "accept")
    for q in queue:
        out = out.when(ident.rlike(q), "queue")
    return out.otherwise("reject")


def append_guard(batch: DataFrame, store: DataFrame, order: str = "nth") -> DataFrame:
    """``batch`` with the status of each append: 409 for a reply to nothing, a fork of nothing or an id that exists (or
    came before in the batch), in this order, else 201.  Replies and forks may name earlier entries of the batch."""
    ids = store.select("id").union(batch.select("id")).distinct().select(F.col("id").alias("known"))
    out = batch.withColumn("again", F.row_number().over(Window.partitionBy("id").orderBy(order)) > 1)
    for column, flag in (("in_reply_to", "reply"), ("fork_of", "fork")):
        out = out.join(ids.withColumnRenamed("known", f"{flag}_id"), F.col(column) == F.col(f"{flag}_id"), "left").withColumn(f"no_{flag}", F.col(column).isNotNull() & F.col(f"{flag}_id").isNull()).drop(f"{flag}_id")
    held = store.select(F.col("id").alias("stored")).distinct()
    out = out.join(held, F.col("id") == F.col("stored"), "left")
    reason = F.when(F.col("no_reply"), "reply-not-found").when(F.col("no_fork"), "fork-not-found").when(F.col("stored").isNotNull() | F.col("again"), "duplicate-id")
    return out.select(*batch.columns, F.when(reason.isNull(), 201).otherwise(409).alias("status"), F.coalesce(reason, F.lit("created")).alias("reason"))


def noop_guard(batch: DataFrame, store: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``batch`` with no_op: the stored document has every value the new one brings (its nulls don't count)."""
    old = store.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.col("_k").isNotNull()
    for c in columns:
        same = same & (F.col(c).isNull() | F.col(c).eqNullSafe(F.col(f"_{c}")))
    return batch.join(old, F.col(key) == F.col("_k"), "left").select(*batch.columns, F.coalesce(same, F.lit(False)).alias("no_op"))


def read_back(written: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """Ids written that the store doesn't have."""
    return written.select(key).join(store.select(key), key, "left_anti")


def new_types(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Types to register."""
    return found.join(registry, ["kind", "id"], "left_anti")
