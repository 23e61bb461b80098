"""A training corpus from documents: five stages, each one operator at work on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, near_dedup, packing, quality_classifier, quality_rules, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good (score of 0.5 or above)."""
    return quality_classifier.keep(docs, common.table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality_rules.keep(docs)


#: Percent of shared shingles from which the near-duplicate stage links two documents.
NEAR = 80


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id."""
    return near_dedup.keep(docs, NEAR)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document with a smaller doc_id has; n_chars follows the text."""
    out = substring_dedup.remove(docs)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*(f"`{x}`" for x in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words stand: bin, its size, and the offset in it."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality), ("quality_rules", rules), ("near_dedup", near), ("substring_dedup", substrings), ("best_fit_packing", pack)]

#: SQL expresses no trained classifier, language model or packing plan; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
