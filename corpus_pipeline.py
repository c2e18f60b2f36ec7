"""A corpus in five stages: quality, exact copies, near copies, secrets, packing.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet in the shared folder and read again as the next stage's ``docs``; all
but the last return the columns of ``docs``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, ngram_join, packing, quality, secret_scan, shared


_stale: list[str] = []


def _clearing(stage):
    """The stage, after the tables are dropped that earlier stages needed: their results are stored by now."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _stale:
            shared.drop_table(_stale.pop(), spark)
        before = set(shared.written())
        out = stage(spark, docs, sf_dir)
        _stale.extend(path for path in shared.written() if path not in before)
        return out

    return run


@_clearing
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, fitted on the labels of ``sf_dir``."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_clearing
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@_clearing
def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


@_clearing
def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("ngram_jaccard_join", dissimilar_documents),
    ("secret_scan", redacted_documents),
    ("best_fit_packing", packed_sequences),
]

#: The classifier's hashed models and noise and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
