"""A corpus pipeline over ``documents``: language identification, exact dedup,
near dedup, mixing to target weights, and encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet to the shared scratch folder
and rereads as the next stage's docs.  All stages but the last return the columns
of ``documents``, each works on every row and whole text that its predecessor
kept, and an empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, dedup, langid, mixing, ngram_join
from foldwise.llm.common import saved, table, vocabulary_path, wide_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are in no learned language."""
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the owner of each normalised text."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of documents
    whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_join.representatives(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the tempered shares of source, language and topic."""
    return mixing.sample(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each whole text and their number."""
    encoded = bpe.encode(docs, vocabulary_path())
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


def _wide(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage`` over Arrow batches of few rows, as documents are wide ones."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        wide_rows(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _wide(language_id)),
    ("exact_dedup", _wide(exact_dedup)),
    ("ngram_join", _wide(near_dedup)),
    ("mixing", _wide(mix_sources)),
    ("bpe", _wide(bpe_encode)),
]

#: Language identification and BPE can't be said in SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
