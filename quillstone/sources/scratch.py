"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's shared folder (``spark.checkpoint.dir``); one of our own only where it is unset."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = _own.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return f"{base.rstrip('/')}/quillstone-{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later plans start from files
    that outlive any executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quill_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete what ``save`` wrote; the frame must no longer be in use."""
    path = getattr(df, "_quill_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (names clash without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"__q_{n}"
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
