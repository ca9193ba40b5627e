"""From raw documents to packed training windows, in five stages.

Each stage takes rows as they come.  Null, empty and word-less texts are scored by the classifier like any other and go at
line dedup, which keeps documents that have a word left.  Documents without an id stay through near-dedup and count as one
unit of their source in mixing; a null source is a source of its own; repeated rows share every decision.  Columns other
than those of documents drop out, whatever their names.  Empty tables stay empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillstone.llm import line_dedup, mixing, near_dedup, packing, quality
from quillstone.sources.scratch import save

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, accepts.  Null, empty and word-less texts are scored like
    any other, on features that are all zero; rows with any id, none or the same are judged by their own text."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no word is left goes too, and so do null, empty and word-less ones.  Documents
    without an id come after all others in the choice of a line's first place; rows equal in id and text are one document."""
    return _documents(line_dedup.dedup_lines(docs, counts=False)).where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of least id, with all its rows.  Documents without an id have no
    group and stay; null and word-less texts are groups of their own."""
    gone = near_dedup.near_groups(docs).where("keep = 0").select(F.col("doc_id").alias("gone"))
    return docs.join(gone.hint("shuffle_hash"), docs.doc_id == F.col("gone"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weight of every source: a document appears as often as its copies say.  A null source is one of its own; documents
    without an id are one unit of their source; a source without a character gets no copies; repeated rows share a number."""
    return mixing.mixed(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed windows of tokens; the copies of a document stand apart.  Null and word-less texts are their separator alone, a
    null id shows as "null"."""
    return packing.pack(docs, copies_apart=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier's training and the pivotal draws can't be said in SQL; tests/llm holds each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
