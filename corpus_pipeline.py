"""The corpus pipeline: quality filter, near-duplicates, mixing to target weights, tokens.

Every stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.

Null and empty texts are documents like others: they are scored, they are copies of each other, they weigh nothing in the mix and have
no tokens.  Null ids, sources and languages stay as they are; null sources are one source.  Rows that are equal are near-duplicates, of
which one stays; ties go to the smaller id.  Texts are taken whole, however long.  An empty table gives an empty table; further columns go
through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, minhash, mixing, quality
from lodestone.llm import text as X
from lodestone.llm.queries import PASS_SCORE


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least PASS_SCORE stay; the model learns as op2 does."""
    X.small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), X.remainder("k", 4) != 2)
    with X.unused_names(docs, "score") as (score,):
        return quality.score(docs, model, column=score).where(f"{score} >= {PASS_SCORE}").drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return minhash.kept(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id with its number of tokens and the digests of its ids and decoded text."""
    X.small_batches(spark)
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: No SQL can train the classifier, sketch the texts or draw the hashed sample; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = X.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = X.settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
