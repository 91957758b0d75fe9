"""From documents to packed training sequences, stage by stage.

Each stage takes the table that the one before it wrote. All but the last return the columns of
`documents`: rows that a stage rejects are gone, and the mix repeats a row as often as it takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repricer.llm import dedup, jaccard, language, mixing, packing
from repricer.llm.common import table, written

#: Share of its grams that a document must have in common with the language it is taken for.
LEAST_SCORE = 0.5

#: No SQL: tokens, languages and random draws are beyond it.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus is labelled with.

    Those without letters go, and those that have little in common with all of the languages.
    """
    found = language.identified(docs)
    known = (F.col("predicted.lang") != language.UNDETERMINED) & (F.col("predicted.score") >= LEAST_SCORE)
    return found.filter(known).select("doc.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return dedup.distinct_documents(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the smallest doc_id."""
    return jaccard.one_of_each_group(docs, jaccard.Similarity(words=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequences and offsets."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
