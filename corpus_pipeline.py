"""A corpus from raw documents to training sequences: quality, exact and near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last give the columns of documents; other columns
are dropped. Null ids, texts, languages and sources are carried through; texts
of any length are read whole; an empty table stays empty through all stages.
Repeated rows are equal texts: one of them stays. Ties are broken by the
smallest doc_id, then by the other columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import dedup, ngram_join, packing, pii, quality
from panelweave.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive limits accept."""
    return quality.assess(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts; a row that repeats its doc_id and text goes too."""
    return dedup.kept_rows(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word similarity of 0.8 or more.

    Rows whose id others share, or is null, are told apart by id and text, so that a row goes only for its own text's sake.
    """
    docs = docs.select(*COLUMNS)
    shared = staged(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_shared")), "shared_ids")
    if not shared.isEmpty():
        return _near_dedup_rows(docs, shared)
    found = ngram_join.with_components(docs, 5, 80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def _near_dedup_rows(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The same where ids are shared: the rows in question get an id of their own, above all others' so that those stay first."""
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    told = docs.join(shared.hint("merge"), docs["doc_id"].eqNullSafe(shared["_shared"]), "left").withColumn("_alike", F.col("_shared").isNotNull() | F.col("doc_id").isNull())
    told = staged(told.select(*COLUMNS, F.when(F.col("_alike"), own).otherwise(F.col("doc_id")).alias("_id")), "told_apart")
    found = ngram_join.with_components(told.select(F.col("_id").alias("doc_id"), "text"), 5, 80)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct()
    return told.join(gone.hint("merge"), "_id", "left_anti").select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mask_pii", mask_pii), ("pack", pack)]
#: Packing by a genetic algorithm cannot be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
