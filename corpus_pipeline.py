"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and reads it again as the
next one's ``docs``. All stages but the last return the columns of documents. Null, empty and repeated rows and
further columns are treated as the operators' docstrings say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stellwerk.llm.columnar import stored, table
from stellwerk.llm.language_id import known_language
from stellwerk.llm.near_dedup import without_near_duplicates
from stellwerk.llm.quality_rules import clean_documents
from stellwerk.llm.registry import packed
from stellwerk.llm.substring_dedup import remove_repeated_passages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are removed; documents that lose most of their text go."""
    return clean_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    return without_near_duplicates(docs, width=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the first document that has them."""
    return remove_repeated_passages(docs).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

# SQL expresses neither the learned stages nor the token ids; tests hold the duplicate stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that pass."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
