"""Measures the sparse retrievers on passages whose holders are known, and writes the report that a release is judged by.

    spark-submit --py-files lodestone.zip jobs/eval_report.py DOCUMENTS PASSAGES OUT [--config jobs/eval_report.json]

One BM25 index of the documents is written to OUT/index and searched by three retrievers: ``opening`` asks with a passage's first
words, ``whole`` with all of it, and ``fused`` with both and the words after the opening, their lists fused by rank.  A retriever is
right where it finds a document that holds the passage word for word; passages that no document holds are not counted.

    OUT/ranks      query_id, first (rank of the first right document, null if none among k), top_id, top_source    by retriever
    OUT/report     queries, hit_at_1, hit_at_5, hit_at_10, mrr, groups (mean number of sources among the found)    by retriever
    OUT/crowded    id, queries: documents among the first five of three questions or more                          by retriever

A run overwrites its tables whole, so running it again, or after a crash, gives the same tables.

Defined results: null and empty documents hold nothing and are not found; null and empty passages are no questions; of equal question
ids the greatest passage counts; ties go to the smaller document id; empty inputs give a report of zeros; further columns are not read.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import evaluation, retrieval, sparse

log = logging.getLogger("lodestone.eval_report")
RANKS = "query_id long, first int, top_id long, top_source string, retriever string"
REPORT = "queries long, hit_at_1 double, hit_at_5 double, hit_at_10 double, mrr double, groups double, retriever string"
CROWDED = "id long, queries long, retriever string"


@dataclass(frozen=True)
class Config:
    key: str = "doc_id"
    text: str = "text"
    source: str = "source"
    question: str = "item_id"
    passage: str = "text"
    opening_words: int = 5
    k: int = 10
    recall: int = 30


def config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return Config(**json.load(f))


def wordings(asked: DataFrame, words: int) -> DataFrame:
    """asked (query_id, passage) -> (query_id, pos, query): the first words, those after them, and the whole."""
    of = fx.tokens(F.col("passage"))
    said = F.array(F.array_join(F.slice(of, 1, words), " "), F.array_join(F.slice(of, words + 1, words), " "), F.col("passage"))
    return asked.select("query_id", F.posexplode(said).alias("pos", "query"))


def searched(asked: DataFrame, docs: DataFrame, built: sparse.Stored, conf: Config) -> DataFrame:
    """(query_id, list_idx, rank, id): one search of the index serves all wordings."""
    said = wordings(asked, conf.opening_words).select(F.struct("query_id", "pos").alias("query_id"), "query")
    found = retrieval.bm25(said, docs, k=max(conf.k, conf.recall), key="doc_id", built=built)
    return found.select("query_id.query_id", F.col("query_id.pos").alias("list_idx"), "rank", "id")


def rankings(lists: DataFrame, conf: Config) -> dict[str, DataFrame]:
    """(query_id, rank, id) by each retriever."""
    alone = lambda pos: lists.where((F.col("list_idx") == pos) & (F.col("rank") <= conf.k)).select("query_id", "rank", "id")
    return {"opening": alone(0), "whole": alone(2), "fused": retrieval.fuse(lists.where(F.col("rank") <= conf.recall), conf.k).select("query_id", "rank", "id")}


def _write(df: DataFrame, path: str, schema: str) -> DataFrame:
    """Overwrites the whole table, so that nothing of an earlier run stays, and reads it back."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("retriever").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def run(spark: SparkSession, documents: str, passages: str, out: str, conf: Config = Config()) -> None:
    """Writes OUT/index, OUT/lists, OUT/gold and OUT/found on the way, then OUT/ranks, OUT/report and OUT/crowded."""
    docs = spark.read.parquet(documents).select(F.col(conf.key).cast("long").alias("doc_id"), F.col(conf.text).alias("text"), F.col(conf.source).cast("string").alias("source"))
    rows = spark.read.parquet(passages).select(F.col(conf.question).cast("long").alias("query_id"), F.col(conf.passage).alias("passage"))
    asked = rows.where("query_id is not null and passage <> ''").groupBy("query_id").agg(F.max("passage").alias("passage"))

    retrieval.write_blocks(docs, f"{out}/index")
    built = retrieval.read_blocks(spark, f"{out}/index")
    searched(asked, docs, built, conf).write.mode("overwrite").parquet(f"{out}/lists")
    evaluation.holders(asked, docs).write.mode("overwrite").parquet(f"{out}/gold")
    lists, gold = spark.read.parquet(f"{out}/lists"), spark.read.parquet(f"{out}/gold")

    by = rankings(lists, conf)
    evaluation.named(by).write.mode("overwrite").parquet(f"{out}/found")
    found = spark.read.parquet(f"{out}/found")
    sources = docs.select(F.col("doc_id").alias("id"), "source")
    asked_for = found.join(gold.select("query_id").distinct(), "query_id", "left_semi").join(retrieval.small(found.select("id").distinct()).join(sources, "id"), "id")
    groups = evaluation.diversity(asked_for, "source", conf.k, ("retriever",)).select("retriever", F.col("mean_groups").alias("groups"))
    top = found.where("rank = 1").select("retriever", "query_id", F.col("id").alias("top_id"))
    named = retrieval.small(top).join(sources.withColumnsRenamed({"id": "top_id", "source": "top_source"}), "top_id", "left")
    ranks = evaluation.first_hits(gold, found, list(by)).join(named, ["retriever", "query_id"], "left")
    report = evaluation.report(gold, by).join(groups, "retriever", "left").fillna({"groups": 0.0})
    crowded = evaluation.attractors(found, by=("retriever",))
    for part, rows, schema in (("ranks", ranks, RANKS), ("report", report, REPORT), ("crowded", crowded, CROWDED)):
        done = _write(rows.select(*[f.split()[0] for f in schema.split(", ")]), f"{out}/{part}", schema)
        log.info("wrote %d rows to %s/%s", done.count(), out, part)
    for r in spark.read.schema(REPORT).parquet(f"{out}/report").orderBy("retriever").collect():
        log.info("%-8s of %d passages: hit@1 %.3f  hit@5 %.3f  hit@10 %.3f  MRR %.3f", r.retriever, r.queries, r.hit_at_1, r.hit_at_5, r.hit_at_10, r.mrr)


def output(spark: SparkSession, out: str) -> DataFrame:
    """The ranks with their retriever's figures, and the crowded documents, in one table."""
    ranks, report, crowded = (spark.read.schema(schema).parquet(f"{out}/{t}") for t, schema in (("ranks", RANKS), ("report", REPORT), ("crowded", CROWDED)))
    return ranks.join(report, "retriever").withColumn("part", F.lit("ranks")).unionByName(crowded.select("retriever", F.col("id").alias("top_id"), "queries", F.lit("crowded").alias("part")), allowMissingColumns=True)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "passages", "out"):
        args.add_argument(name)
    args.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "eval_report.json"))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("eval_report").getOrCreate()
    try:
        log.info("reading %s and %s", given.documents, given.passages)
        run(spark, given.documents, given.passages, given.out, config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
