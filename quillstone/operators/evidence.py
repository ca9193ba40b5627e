"""Reads of the evidence log.  ``at`` is a string and compares as one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names

COMPACT = ("id", "type", "claim_type", "author", "at", "tag_names", "subject", "pattern_id", "session_id", "in_reply_to", "fork_of", "ephemeral")  # all but the body


def tags_all(wanted: list[str], column: str = "tag_names") -> Column:
    """Every wanted tag is among the row's tag names."""
    return F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), F.col(column))) == 0 if wanted else F.lit(True)


def tags_any(wanted: list[str], column: str = "tags") -> Column:
    """Some wanted tag is among the row's tags, whole keywords compared."""
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(True)


def after_cursor(at: str, ident: str) -> Column:
    """Rows that follow (at, id) when newest come first."""
    return (F.col("at") < at) | ((F.col("at") == at) & (F.col("id") < ident))


def before_cursor(at: str, ident: str) -> Column:
    """Rows that follow (at, id) when oldest come first."""
    return (F.col("at") > at) | ((F.col("at") == at) & (F.col("id") > ident))


def select(evidence: DataFrame, type: str | None = None, claim_type: str | None = None, author: str | None = None, session_id: str | None = None, fork_of: str | None = None, since: str | None = None, before: str | None = None, tags: list[str] | None = None, tags_exact: list[str] | None = None, subject_type: str | None = None, subject_id: str | None = None, pattern_id: str | None = None, include_ephemeral: bool = True) -> DataFrame:
    """All given filters together: ``since`` is inclusive and ``before`` exclusive, both on the string; ephemeral rows go
    only where asked, and a row without the flag stays."""
    equal = {"type": names.canonical(type), "claim_type": names.canonical(claim_type), "author": author, "session_id": session_id, "fork_of": fork_of, "pattern_id": names.canonical(pattern_id)}
    for column, value in equal.items():
        if value is not None:
            evidence = evidence.where(F.col(column) == value)
    if since is not None:
        evidence = evidence.where(F.col("at") >= since)
    if before is not None:
        evidence = evidence.where(F.col("at") < before)
    if tags:
        evidence = evidence.where(tags_all(tags))
    if tags_exact:
        evidence = evidence.where(tags_any(tags_exact))
    if subject_type is not None:
        evidence = evidence.where(names.name_col(F.col("subject.ref_type")) == subject_type)
    if subject_id is not None:
        evidence = evidence.where(F.col("subject.ref_id") == subject_id)
    if not include_ephemeral:
        evidence = evidence.where(~F.coalesce("ephemeral", F.lit(False)))
    return evidence


def newest(evidence: DataFrame, limit: int) -> DataFrame:
    """A page in order: only ``limit`` rows a partition leave the scan."""
    return evidence.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def oldest(evidence: DataFrame, limit: int) -> DataFrame:
    return evidence.orderBy("at", "id").limit(limit)


@dataclass
class Page:
    entries: DataFrame
    count: int
    limit: int
    next_cursor: tuple[str, str] | None


def page(evidence: DataFrame, limit: int | str | None = None, cursor: tuple[str, str] | None = None, whole: bool = True, **filters) -> Page:
    """A newest-first page, of whole or compact entries, and the cursor of the next one (present where the page is full, so
    the next may be empty)."""
    n = names.limit(limit, 100, 1000, layered=False)
    rows = select(evidence, **filters)
    rows = rows if whole else compact(rows)
    if cursor:
        rows = rows.where(after_cursor(*cursor))
    rows = newest(rows, n)
    keys = rows.select("at", "id").collect()  # at most 1000 keys
    return Page(rows, len(keys), n, (keys[-1].at, keys[-1].id) if len(keys) == n else None)


def compact(evidence: DataFrame) -> DataFrame:
    """Entries without their bodies, which are then not read."""
    return evidence.select(*COMPACT)


def count(evidence: DataFrame, **filters) -> DataFrame:
    return select(evidence, **filters).agg(F.count("*").alias("count"))


def sessions(evidence: DataFrame, since: str | None = None, author: str | None = None) -> DataFrame:
    """By session: entries, types (with colons) and authors in order, first and last time.  Rows without one don't count."""
    rows = select(evidence, since=since, author=author).where(F.col("session_id").isNotNull())
    return rows.groupBy("session_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_set(names.rendered(F.col("type")))).alias("types"), F.array_sort(F.collect_set("author")).alias("authors"), F.min("at").alias("earliest_at"), F.max("at").alias("latest_at"))


def sessions_page(evidence: DataFrame, limit: int | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(sessions newest first, totals over all of them)."""
    rows = sessions(evidence, **filters)
    total = rows.agg(F.count("*").alias("total_sessions"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_entries"))
    return rows.orderBy(F.desc("latest_at"), F.desc("session_id")).limit(names.limit(limit, 100, 5000)), total


STEPS = 8
FEW = 10_000  # ancestors that are broadcast


def _met(found: DataFrame, size: int) -> DataFrame:
    """Rows as one side of a join: broadcast only if they are few, so that no round sends a large table through the driver."""
    return found.hint("broadcast" if size <= FEW else "merge")


def chain(evidence: DataFrame, ident: str, steps: int = STEPS) -> DataFrame:
    """The entry ``ident`` and what it replies to, root first (column ``depth`` counts from the root); a cycle or a missing
    parent ends it, an unknown id gives no rows.

    The first ``steps`` replies are followed one by one, which joins a single row each time; what is left of a longer
    thread by doubling: round k joins the ancestors so far with the links of 2**k steps, so a million replies take twenty
    rounds more, each written to the shared folder.  Of these tables only few ancestors are broadcast."""
    from ..sources.scratch import save

    links = evidence.select("id", F.col("in_reply_to").alias("up"))
    near = links.sparkSession.sql(
        """with recursive walk(id, up, n, seen) as (
             select id, up, 0, array(id) from {links} where id = :ident
             union all
             select l.id, l.up, walk.n + 1, array_append(walk.seen, l.id) from walk join {links} l on l.id = walk.up where walk.n < :steps and not array_contains(walk.seen, l.id))
           select id, up, n from walk""",
        args={"ident": ident, "steps": steps},
        links=links,
    )
    found = save(near.select("id", F.col("n").cast("bigint").alias("n")), "chain")
    if found.where(F.col("n") == steps).limit(1).count():
        jump, width, size = save(links.where("up is not null"), "jump"), 1, 0
        found = found.where("n = 0")
        while True:
            more = _met(found, size).join(jump.hint("merge"), "id").select(F.col("up").alias("id"), (F.col("n") + width).alias("n"))
            found = save(found.union(more).groupBy("id").agg(F.min("n").alias("n")), "chain")
            now = found.count()
            if now == size:
                break
            size, width = now, 2 * width
            far = jump.toDF("mid", "far")
            jump = save(jump.hint("merge").join(far, F.col("up") == F.col("mid")).select("id", F.col("far").alias("up")), "jump")
        found = _met(found, size)
    known = evidence.join(found, "id")
    top = found.join(evidence.select("id"), "id", "left_semi").agg(F.max("n").alias("top"))
    return known.crossJoin(F.broadcast(top)).withColumn("depth", F.col("top") - F.col("n")).drop("top", "n").orderBy("depth")


def roots(evidence: DataFrame) -> DataFrame:
    """(id, root, depth) of every entry, by pointer jumping: each round doubles the steps taken, so a thread of a million
    replies takes twenty joins.  A missing parent ends a chain; entries that lead into a cycle have no root.  Only entries
    without a root so far are joined again, with those they point to."""
    from ..sources.scratch import save

    links = save(evidence.select("id", F.col("in_reply_to").alias("up")), "links")
    known = links.select(F.col("id").alias("known"))
    start = links.join(known, F.col("up") == F.col("known"), "left").select("id", F.col("known").alias("up"), F.when(F.col("known").isNull(), F.col("id")).alias("root"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    at, n = save(start, "jump"), links.count()
    done, open_ = at.where("root is not null"), at.where("root is null")
    for _ in range(max(1, n).bit_length() + 1):
        if open_.limit(1).count() == 0:
            break
        far = done.unionByName(open_).toDF("far_id", "far_up", "far_root", "far_depth")
        step = open_.join(far, F.col("up") == F.col("far_id"), "left").select("id", F.when(F.col("far_id").isNull(), F.col("up")).otherwise(F.col("far_up")).alias("up"), F.col("far_root").alias("root"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"))
        now = save(step, "jump")
        done, open_ = done.unionByName(now.where("root is not null")), now.where("root is null")
    return done.unionByName(open_).select("id", "root", F.when(F.col("root").isNotNull(), F.col("depth")).alias("depth"))
