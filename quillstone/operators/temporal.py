"""Bitemporal reads over an append-only operation log.

A row of the log is an operation (put or delete) on an id, valid over [valid_from, valid_to) and written at system_time;
ordinal orders operations of one moment.  What holds at a valid time is the last operation written whose interval covers
it, however the intervals follow each other."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

LOG = ("op", "valid_from", "valid_to", "system_time", "ordinal")


def _when(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(value.replace(tzinfo=None) if isinstance(value, datetime) else value)


def covering(log: DataFrame, valid=None, system=None) -> DataFrame:
    """The operations written up to ``system`` whose interval covers ``valid``.  None is now and latest."""
    kind = log.schema["valid_from"].dataType.simpleString()
    now = F.current_timestamp().cast(kind) if valid is None else _when(valid).cast(kind)
    seen = log if system is None else log.where(F.col("system_time") <= _when(system).cast(log.schema["system_time"].dataType.simpleString()))
    return seen.where((F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (now < F.col("valid_to"))))


def as_of(log: DataFrame, valid=None, system=None, key: str = "id") -> DataFrame:
    """The documents that hold at valid time ``valid`` by what was written up to ``system``.
    One aggregation by id: the winner is a maximum, so partial results combine before the shuffle; conditions on the key
    pass below it."""
    rest = [c for c in log.columns if c not in LOG and c != key]
    last = F.max_by(F.struct("op", *rest), F.struct("system_time", "ordinal"))
    return covering(log, valid, system).groupBy(key).agg(last.alias("last")).where("last.op = 'put'").select(key, *[F.col(f"last.`{c}`").alias(c) for c in rest])


def current(log: DataFrame, key: str = "id") -> DataFrame:
    return as_of(log, key=key)


def put(docs: DataFrame, at, ordinal: int = 0, valid_from=None, valid_to=None) -> DataFrame:
    """Operations that replace each document whole."""
    start = _when(at if valid_from is None else valid_from).cast("timestamp")
    return docs.select(F.lit("put").alias("op"), start.alias("valid_from"), _when(valid_to).cast("timestamp").alias("valid_to"), _when(at).cast("timestamp").alias("system_time"), F.lit(ordinal).cast("bigint").alias("ordinal"), *docs.columns)


def delete(docs: DataFrame, at, ordinal: int = 0, valid_from=None) -> DataFrame:
    """Operations that end each document; its history stays."""
    return put(docs, at, ordinal, valid_from).withColumn("op", F.lit("delete"))


def erase(log: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The log without any trace of ``ids``."""
    return log.join(ids.select(key).distinct(), key, "left_anti")
