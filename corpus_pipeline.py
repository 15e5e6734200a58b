"""From raw documents to packed sequences: five stages, each working on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import near_copies, packing, pii, quality, substrings
from sigloom.llm.common import read_table, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_copies.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a document left without a word goes."""
    kept = substrings.stripped(docs).where(F.col("text").isNull() | (F.col("text") != ""))
    return _measured(kept)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _measured(pii.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii_redaction),
    ("packing", best_fit_packing),
]

#: Tokenizing and sketching have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is stored before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
