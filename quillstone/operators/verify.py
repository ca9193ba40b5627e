"""Verification: canonical documents, checksums, comparison of two stores."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def canonical(x):
    """A document for comparison: keys in order and folded after their namespace, nil entries of maps dropped (those of
    vectors kept), sets as sorted vectors."""
    if isinstance(x, dict):
        pairs = {fold_key(k): canonical(v) for k, v in x.items() if v is not None}
        return {k: pairs[k] for k in sorted(pairs)}
    if isinstance(x, (set, frozenset)):
        return sorted((canonical(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
    if isinstance(x, (list, tuple)):
        return [canonical(v) for v in x]
    return x


def fold_key(key: str) -> str:
    """Lower case for the name, not for the namespace."""
    space, slash, name = str(key).partition("/")
    return space + slash + name.lower() if slash else space.lower()


def checksum(x) -> str:
    return hashlib.md5(json.dumps(canonical(x), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def compare_docs(source: dict, target: dict | None) -> dict:
    """Whether the target is missing, the keys whose values differ (of those the source has), and the keys that can't be
    verified because their name holds a slash of its own."""
    want = {k: v for k, v in source.items() if v is not None}
    odd = sorted(k for k in want if str(k).lstrip(":").count("/") > 1)
    if target is None:
        return {"missing": True, "keys": [], "unverifiable": odd}
    have = canonical(target)
    return {"missing": False, "keys": sorted(k for k, v in want.items() if k not in odd and have.get(fold_key(k)) != canonical(v)), "unverifiable": odd}


def row_text(columns: list[str]) -> Column:
    """A row as sorted name=value lines, nulls left out."""
    each = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns)]
    return F.concat_ws("\n", *each)


def row_checksum(columns: list[str]) -> Column:
    return F.md5(row_text(columns).cast("binary"))


def canonical_column(c: Column, kind: DataType) -> Column:
    """A nested value with its fields folded and in order, at every level."""
    if isinstance(kind, StructType):
        fields = sorted(kind, key=lambda f: fold_key(f.name))
        return F.when(c.isNotNull(), F.struct(*[canonical_column(c.getField(f.name), f.dataType).alias(fold_key(f.name)) for f in fields]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(c, lambda x: canonical_column(x, kind.elementType))
    return c


def canonical_json(rows: DataFrame, columns: list[str]) -> Column:
    """Each row as JSON for comparison: keys folded and in order, nils of maps dropped, those of vectors kept."""
    every = sorted(columns, key=fold_key)
    return F.to_json(F.struct(*[canonical_column(F.col(f"`{c}`"), rows.schema[c].dataType).alias(fold_key(c)) for c in every]))


def document_checksum(rows: DataFrame, columns: list[str]) -> Column:
    return F.md5(canonical_json(rows, columns))


def compare(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, status, keys): every key of either side as same, missing (from target), extra, or different with the columns that
    differ.  Only columns that the source row has count."""
    s = source.select(key, F.struct(*columns).alias("s"))
    t = target.select(F.col(key).alias("_k"), F.struct(*columns).alias("t"))
    both = s.join(t, F.col(key) == F.col("_k"), "full_outer")
    bad = F.array_compact(F.array(*[F.when(F.col(f"s.{c}").isNotNull() & ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in columns]))
    status = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "extra").when(F.size(bad) > 0, "different").otherwise("same")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"), F.when(status == "different", F.array_join(bad, ",")).otherwise("").alias("keys"))


def population(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """By table the rows of both sides; a table that only one side has is skipped, which isn't the same as passed."""
    out = None
    for name in sorted({*source, *target}):
        a, b = source.get(name), target.get(name)
        some = a if a is not None else b
        count = lambda d: d.agg(F.count("*").alias("n")) if d is not None else some.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("n"))
        one = count(a).toDF("source").crossJoin(count(b).toDF("target")).select(F.lit(name).alias("table"), "source", "target", F.when(F.col("source").isNull() | F.col("target").isNull(), "skip").when(F.col("source") == F.col("target"), "pass").otherwise("fail").alias("status"))
        out = one if out is None else out.union(one)
    return out
