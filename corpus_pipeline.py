"""The corpus pipeline: documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import bpe, jaccard, language, lines, packing
from fathomline.llm.shared import table, written

#: SQL can't express the language stage; tests compare the stages with brute force.
ORACLE_SQL = None
#: Documents up to which the list of dropped ones is broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; a missing lang is filled with the prediction, or stays null
    where no language could be learned."""
    model = language.train(docs)
    if not model.languages:
        return language.with_letters(docs)
    found = language.identify(docs, model)
    # where it is a label, the mark of texts without a letter tells nothing
    kept = language.with_letters(found) if language.UNKNOWN in model.languages else found.where(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line resembles go, and documents of which nothing but blank lines is left."""
    clean = lines.dedup_lines(docs)
    kept = clean.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n\u000b\u000c")) != ""))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays (null ids come last).
    Different texts under one id, or without an id, are different documents."""
    unnamed = docs.where(F.col("doc_id").isNull() | (F.col("doc_id") == jaccard.LAST_ID))
    if not unnamed.isEmpty() or not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _by_id_and_text(docs)
    joined = jaccard.jaccard_components(docs)
    gone = written(joined.where("component_id < doc_id").select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    return kept.select(*docs.columns)


def _by_id_and_text(docs: DataFrame) -> DataFrame:
    """The same where ids are null or repeated: a document is an id with a set of shingles."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(jaccard.LAST_ID)).alias("_id")
    marked = jaccard.marked_components(docs).where("part is not null").select(number, F.col("sig").alias("_sig"), "part").distinct()
    marked = written(marked, "near-duplicates-marked")
    first = marked.groupBy("part").agg(F.min(F.struct("_id", "_sig")).alias("first"))
    gone = written(marked.join(first, "part").where(F.struct("_id", "_sig") != F.col("first")).select("_id", "_sig"), "near-duplicates")
    signed = jaccard.with_signature(docs, "_sig").withColumn("_id", number)
    kept = signed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["_id", "_sig"], "left_anti")
    return kept.dropDuplicates(["_id", "_sig"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in windows of 2048 ids."""
    return packing.pack_documents(docs, bpe.vocabulary_path())


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
