"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, tokens.

Each stage takes the rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tidemark.llm.registry import table, tokenizer_path
from tidemark.llm.shared import collected, dropped, noted, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[DataFrame] = []


def stage(function: Stage) -> Stage:
    """A stage whose own tables in the shared folder go when the next one begins.

    By then its rows are written, as each stage reads what the one before it has written.
    """
    @wraps(function)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(*_left)
        _left.clear()
        collected(spark)
        with noted() as made:
            out = function(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return clean


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit_labelled(docs, table(spark, sf_dir, "labels"))
    return quality.good_only(docs, model)


@stage
def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


@stage
def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five words, Jaccard similarity of 0.8)."""
    return jaccard_join.without_near_copies(docs)


@stage
def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    return bpe.bpe_encode(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("jaccard_join", no_near_copies),
    ("decontamination", no_leaks),
    ("bpe", tokens),
]

#: A fitted classifier and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
