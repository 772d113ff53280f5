"""The thin queries over the operators of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import align, ann, bpe, chat, html, lm, media, minhash, mixing, quality, sharding, suffix
from lodestone.llm import text as X
from lodestone.sources.layout import spread

PASS_SCORE = 0.7


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    docs = X.documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), X.remainder("k", 4) != 2)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (X.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(X.documents(spark, sf_dir, "doc_id", "text"), X.remainder("doc_id", 7) != 2)


def op4_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(X.documents(spark, sf_dir, "doc_id", "text"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark, 256)
    return media.features(media.store(X.documents(spark, sf_dir, "doc_id", "text")))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(X.documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "class_id")


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(X.documents(spark, sf_dir, "doc_id", "text", "source"))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    return html.extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(chat.format_chats(rows.unionByName(more)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.small_batches(spark)
    return bpe.digest(X.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(X.documents(spark, sf_dir, "doc_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(X.documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_adaptive_scan, op2_quality, op3_katz_backoff, op4_feistel_sharding, op5_progressive_jpeg, op6_dart_minhash, op7_pareto_mixing, op8_line_blocks, op9_chat_format, op10_bpe, op11_suffix_dedup, op12_token_alignment)}
ORACLE_SQL: dict[str, str] = {"op9_chat_format": chat.ORACLE}
