"""A store: typed tables of operations in a folder, and a log of commits.

A write puts its files into folders of its own and then makes one small commit file, which names the folders of every table:
all tables of a write are seen or none, and what a crash leaves behind no reader looks at.  Commit files are numbered and
are only made where there is none of that number, so of two writers one goes first and the other tries again on top of it.
Erasing and compacting write new folders and commit them; nothing that a reader may need is overwritten in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import temporal

LOG = "op string, valid_from timestamp, valid_to timestamp, system_time timestamp, ordinal bigint"
VIEWS = {
    "evidence": "id string, type string, claim_type string, author string, at string, body string, tags array<string>, tag_names array<string>, subject struct<ref_type: string, ref_id: string>, pattern_id string, session_id string, in_reply_to string, fork_of string, conjecture boolean, ephemeral boolean",
    "hyperedges": "id string, type string, endpoints array<string>, ends array<struct<entity_id: string>>, labels array<string>, props string, repo string, source_file string, timestamp double, entry string",
    "entities": "id string, name string, type string, external_id string, source string, props string",
    "relations": "id string, type string, src string, dst string, note string, `order` string, props string",
    "type-catalog": "id string, kind string, type string, parent string, aliases array<string>",
    "docs": "id string, body string",
    "misc": "id string, body string",
}
#: Tables without operations: kept up by whoever writes the table they follow, in the same commit.
PLAIN = {
    "postings": "token string, id string, tf int, places array<int>, dl int",
    "text-docs": "id string, dl int",
    "gate-queue": "id string, type string, disposition string, at timestamp",
    "memory-projection": "id string, endpoints array<string>, entry_id string, entry_type string, claim_type string, author string, session_id string, hook string",
}
#: An id is written once (the append guard sees to it), so reads need no aggregation and every filter reaches the scan.
APPEND_ONLY = frozenset({"evidence"})
FOLLOW = {"evidence": ("postings", "text-docs")}  # erased with it
CLUSTER = {"postings": "token"}
FILE_MB = 128
FEW = 100_000  # ids that are broadcast, once they have been counted


class Conflict(RuntimeError):
    """Another writer has committed since the basis that a write was judged on."""


def schema(table: str) -> StructType:
    return StructType.fromDDL(PLAIN[table] if table in PLAIN else f"{LOG}, {VIEWS[table]}")


class Store:
    """Tables in a folder.  ``clock`` gives the system time of writes."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] | None = None):
        self.spark, self.path = spark, path
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self._repeats: dict[str, tuple[list[str], DataFrame]] = {}

    # commits

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def state(self) -> tuple[int, dict]:
        """Number and content of the last commit: folders by table, and notes.  A commit file that a crash cut off counts
        for its number only."""
        fs, where = self._at("commits")
        if not fs.exists(where):
            return 0, {"tables": {}, "notes": {}}
        found = sorted((f.getPath().getName() for f in fs.listStatus(where)), reverse=True)
        found = [f for f in found if f.endswith(".json") and not f.startswith((".", "_"))]
        last = int(found[0].split(".")[0]) if found else 0
        for name in found:
            fs, one = self._at(f"commits/{name}")
            stream = fs.open(one)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return last, json.loads(text)
            except ValueError:
                continue
        return last, {"tables": {}, "notes": {}}

    @property
    def version(self) -> int:
        return self.state()[0]

    def _publish(self, number: int, state: dict) -> bool:
        fs, where = self._at(f"commits/{number:020d}.json")
        try:
            stream = fs.create(where, False)
        except Py4JJavaError:
            if fs.exists(where):
                return False
            raise
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        return True

    def commit(self, frames: dict[str, DataFrame], base: int | None = None, replace: Iterable[str] = (), notes: dict | None = None) -> int:
        """Write the frames (with their tables' columns) as one commit and return its number.  With ``base``, only on top of
        that commit (else ``Conflict``); the tables in ``replace`` consist of their frames alone afterwards."""
        while True:
            last, state = self.state()
            if base is not None and last != base:
                raise Conflict(f"{last} follows {base}")
            number, made = last + 1, {}
            for table, df in frames.items():
                want = schema(table)
                have = {c.lower() for c in df.columns}
                cols = [(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
                if table not in PLAIN and table not in replace:  # operations of one commit keep their order, and follow those before
                    cols = [(F.lit(number << 32) + F.coalesce(F.col("ordinal"), F.lit(0))).alias("ordinal") if f.name == "ordinal" else c for f, c in zip(want, cols)]
                made[table] = f"{table}/{number}-{uuid.uuid4().hex[:12]}"
                df.select(*cols).write.parquet(f"{self.path}/data/{made[table]}")
            tables = {t: ([] if t in replace else state["tables"].get(t, [])) + ([made[t]] if t in made else []) for t in {*state["tables"], *made, *replace}}
            if self._publish(number, {"tables": tables, "notes": state["notes"] | (notes or {})}):
                return number
            for name in made.values():
                self._remove(f"data/{name}")

    def _remove(self, name: str) -> None:
        fs, where = self._at(name)
        fs.delete(where, True)

    # reads

    def folders(self, table: str, after: int = 0) -> list[str]:
        """The folders of a table, of commits after ``after``."""
        return [f for f in self.state()[1]["tables"].get(table, []) if int(f.rpartition("/")[2].split("-")[0]) > after]

    def read(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:  # known to be empty, so that joins with it vanish
            return self.spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table)])
        return self.spark.read.schema(schema(table)).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def log(self, table: str) -> DataFrame:
        """All operations on a table (or rows of a plain one); one that was never written has none."""
        return self.read(table, self.folders(table))

    def _again(self, table: str, folders: list[str]) -> DataFrame:
        """Hashes of the ids of which the log has several operations; found once for the log as it is."""
        from .scratch import save

        if self._repeats.get(table, (None,))[0] != folders:
            hashes = self.read(table, folders).groupBy(F.xxhash64("id").alias("hash")).agg(F.count("*").alias("n"))
            self._repeats[table] = folders, save(hashes.where("n > 1").select("hash"), "again")
        return self._repeats[table][1]

    def table(self, table: str, valid=None, system=None, where: Column | None = None) -> DataFrame:
        """The documents of a table that satisfy ``where``, now or as of two times.

        A condition on the id reaches the scan by itself.  Any other must not be put before the choice of the version that
        holds, so ``where`` goes to the scan once to find the operations that ever satisfied it.  If they are few, only the
        histories of their ids are aggregated and judged again.  Else an id of one operation is judged where it is read, and
        the histories of others are aggregated; all are where those are many."""
        folders = self.folders(table)
        log = self.read(table, folders)
        cols = [f"`{f.name}`" for f in StructType.fromDDL(VIEWS[table])]
        if table in APPEND_ONLY:
            rows = temporal.covering(log, valid, system).where("op = 'put'")
        elif where is None:
            rows = temporal.as_of(log, valid, system)
        else:
            found = log.where(where).select("id")
            if found.count() <= FEW:
                rows = temporal.as_of(log.join(F.broadcast(found.distinct()), "id", "left_semi"), valid, system)
            elif (again := self._again(table, folders)).count() <= FEW:
                again, own = F.broadcast(again), F.xxhash64("id") == F.col("hash")
                once = temporal.covering(log.where(where).join(again, own, "left_anti"), valid, system).where("op = 'put'")
                rows = once.select(*cols).unionByName(temporal.as_of(log.join(again, own, "left_semi"), valid, system).select(*cols))
            else:
                rows = temporal.as_of(log, valid, system)
        rows = rows.select(*cols)
        return rows if where is None else rows.where(where)

    # writes

    def ops(self, table: str, ops: Iterable[tuple[str, dict]], valid_from: datetime | None = None, valid_to: datetime | None = None) -> DataFrame:
        """Operations (put or delete, document) as a frame for ``commit``."""
        now = self.clock()
        fields = [f.name for f in StructType.fromDDL(VIEWS[table])]
        rows = [(op, valid_from or now, valid_to, now, n, *(d.get(f) for f in fields)) for n, (op, d) in enumerate(ops)]
        return self.spark.createDataFrame(rows, schema(table))

    def puts(self, table: str, docs: DataFrame) -> DataFrame:
        """A DataFrame of documents with the view's columns as operations, without passing through the driver."""
        now = F.lit(self.clock().astimezone(timezone.utc).replace(tzinfo=None)).cast("timestamp")
        return temporal.put(docs, now)

    def write(self, table: str, ops: Iterable[tuple[str, dict]], valid_from: datetime | None = None, valid_to: datetime | None = None) -> None:
        """Append operations in one commit."""
        ops = list(ops)
        if ops:
            self.commit({table: self.ops(table, ops, valid_from, valid_to)})

    def append_documents(self, table: str, docs: DataFrame) -> None:
        self.commit({table: self.puts(table, docs)})

    def erase(self, table: str, ids: DataFrame) -> None:
        """Commit the table, and those that follow it, without any trace of ``ids``; then delete the old files."""
        while True:
            base, state = self.state()
            every = [t for t in (table, *FOLLOW.get(table, ())) if state["tables"].get(t)]
            if not every:
                return
            kept = {t: temporal.erase(self.read(t, state["tables"][t]), ids) for t in every}
            try:
                self.commit(kept, base=base, replace=every)
                break
            except Conflict:
                continue
        for t in every:
            for name in state["tables"][t]:
                self._remove(f"data/{name}")

    def compact(self, file_mb: int = FILE_MB) -> None:
        """Merge the small files of many commits into files of about ``file_mb``, in order of id (postings: of token), so
        that reads by it skip most.  The rows stay as they are; ``vacuum`` deletes the old files."""
        while True:
            base, state = self.state()
            frames = {}
            for t, names in state["tables"].items():
                if len(names) < 2:
                    continue
                size = 0
                for name in names:
                    fs, where = self._at(f"data/{name}")
                    size += fs.getContentSummary(where).getLength()
                key = CLUSTER.get(t, "id")
                frames[t] = self.read(t, names).repartitionByRange(max(1, -(-size // (file_mb << 20))), key).sortWithinPartitions(key)
            try:
                if frames:
                    self.commit(frames, base=base, replace=list(frames))
                return
            except Conflict:
                continue

    def vacuum(self) -> int:
        """Delete the folders that the last commit doesn't name; for times when no older reader or writer is at work."""
        named = {name for names in self.state()[1]["tables"].values() for name in names}
        gone = 0
        fs, where = self._at("data")
        for table in fs.listStatus(where) if fs.exists(where) else []:
            for one in fs.listStatus(table.getPath()):
                name = f"{table.getPath().getName()}/{one.getPath().getName()}"
                if name not in named:
                    self._remove(f"data/{name}")
                    gone += 1
        return gone
