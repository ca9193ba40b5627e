"""Derived tables kept up with an append-only stream: postings and the memory projection by endpoint.

The stream is read in commit order and its checkpoint says what has been applied, so a back-dated entry is never missed.
A derived table is a set of files per batch id: applying a batch again replaces its own files only, and a reader keeps for
each key the rows of the latest batch that touched it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import text
from ..sources.scratch import folder


def apply(source: DataFrame, derive: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Run the stream until it has caught up; each batch's derived rows become the partition of its id."""

    def write(batch: DataFrame, epoch: int) -> None:
        derive(batch).withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    run = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """For each key the rows of the last batch that has it."""
    rows = spark.read.parquet(target).withColumn("last", F.max("batch").over(Window.partitionBy(key)))
    return rows.where("batch = last").drop("batch", "last")


def _replay(rows: DataFrame, derive, batches: int) -> tuple[SparkSession, str]:
    spark = rows.sparkSession
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64 * spark.sparkContext.defaultParallelism) // batches)
    rows.repartition(batches * files, "id").write.parquet(f"{base}/in")  # an id is in one file, and so in one batch
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    apply(source, derive, f"{base}/out", f"{base}/checkpoint")
    return spark, f"{base}/out"


def replay_postings(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(id, token, tf) of (id, text), built batch by batch from a stream of them."""
    spark, out = _replay(docs, lambda b: text.postings(b.dropDuplicates(["id"])), batches)
    return latest(spark, out, "id")


def replay_projection(ends: DataFrame, batches: int = 3) -> DataFrame:
    """(id, endpoint) of a stream of edges' endpoints; an edge that comes again replaces its endpoints."""
    spark, out = _replay(ends, lambda b: b.distinct(), batches)
    return latest(spark, out, "id")
