"""A stored BM25 index of posting blocks with score bounds, and a search that leaves out blocks that cannot matter.

Documents are dealt into parts by a hash of their id.  A *block* is one token's postings in one part: the ids with their counts and lengths,
and beside them the greatest count and the least length, which bound what the token can add to any score there, whatever the parameters.

A search reads the bounds of its tokens' blocks first (their columns only) and sums them over a query's tokens: no document of a part can
score more.  The parts with the greatest sums are scored whole; the k-th best score there is a floor for the k-th best of all.  Then only
parts whose sum reaches the floor are scored.  Parts below it are never opened, and the ranking is the same as without bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: folders a stored index is dealt to by token; a search reads those of its tokens
BUCKETS = 64
#: documents of a part, and parts that are scored first for each query
PART_DOCS, FIRST_PARTS = 256, 4
#: what rounding to six places can add to a score
SLACK = 1e-6


@dataclass(frozen=True)
class Stored:
    """blocks (bucket, token, part, ids, tfs, dls, tf_most, dl_least), words (token, df, ctf), size (n)."""

    blocks: DataFrame
    words: DataFrame
    size: DataFrame


def bucket(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write(post: DataFrame, words: DataFrame, size: DataFrame, path: str, part_docs: int = PART_DOCS) -> None:
    """post (token, id, tf, dl).  A frequent token's postings are many blocks, so no task gathers them all."""
    size.write.mode("overwrite").parquet(f"{path}/size")
    words.write.mode("overwrite").parquet(f"{path}/words")
    n = post.sparkSession.read.parquet(f"{path}/size").first()["n"] or 0.0
    parts = max(1, -(-int(n) // part_docs))
    each = post.where("token is not null").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    listed = each.groupBy("token", "part").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("ps"), F.max("tf").alias("tf_most"), F.min("dl").alias("dl_least"))
    dealt = listed.select(bucket("token").alias("bucket"), "token", "part", F.col("ps.id").alias("ids"), F.col("ps.tf").alias("tfs"), F.col("ps.dl").alias("dls"), "tf_most", "dl_least")
    # a small index is one file a bucket
    dealt.repartition("bucket", F.pmod("part", F.lit(min(8, 1 + parts // 32)))).sortWithinPartitions("bucket", "token", "part").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, kind: str = "long") -> Stored:
    """kind: the type of the documents' ids."""
    blocks = f"token string, part long, ids array<{kind}>, tfs array<double>, dls array<double>, tf_most double, dl_least double, bucket int"
    schemas = {"blocks": blocks, "words": "token string, df double, ctf double", "size": "n double"}
    return Stored(*(spark.read.schema(s).parquet(f"{path}/{t}") for t, s in schemas.items()))


def gain(weight: Column, tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What a token of this weight adds to a document's score."""
    return weight * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def bounded(weighed: DataFrame, index: Stored, k1: float, b: float) -> DataFrame:
    """weighed (query_id, token, weight, avgdl, bucket) -> (query_id, token, weight, avgdl, bucket, part, bound), a row for each block of a query's tokens."""
    heads = index.blocks.select("bucket", "token", "part", "tf_most", "dl_least").join(weighed, ["bucket", "token"])
    # a token of negative weight adds nothing at best
    return heads.withColumn("bound", F.greatest(F.lit(0.0), gain(F.col("weight"), F.col("tf_most"), F.col("dl_least"), F.col("avgdl"), k1, b))).drop("tf_most", "dl_least")


def scored(chosen: DataFrame, index: Stored, k1: float, b: float) -> DataFrame:
    """chosen (query_id, token, weight, avgdl, bucket, part), all of a query's tokens in a part -> (query_id, part, id, score), scores above 0."""
    opened = index.blocks.select("bucket", "token", "part", "ids", "tfs", "dls").join(chosen, ["bucket", "token", "part"])
    each = opened.select("query_id", "part", "weight", "avgdl", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    part = gain(F.col("weight"), F.col("p.tfs"), F.col("p.dls"), F.col("avgdl"), k1, b)
    return each.groupBy("query_id", "part", F.col("p.ids").alias("id")).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


@dataclass(frozen=True)
class Search:
    """first: rows of the parts that were scored first; rest: of those that reached the floor; left_out: (query_id, part) never opened."""

    first: DataFrame
    rest: DataFrame
    left_out: DataFrame


def search(weighed: DataFrame, index: Stored, k: int, k1: float, b: float, settled=lambda df: df) -> Search:
    """Rows (query_id, part, id, score), among them the k best of each query.

    ``settled`` keeps a frame that is used again; the planner knows the size of what was kept, and sends it to all tasks if that is small.
    """
    each = settled(bounded(weighed, index, k1, b))
    sums = each.groupBy("query_id", "part").agg(F.sum("bound").alias("most"))
    order = W.partitionBy("query_id").orderBy(F.desc("most"), "part")
    head = sums.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST_PARTS).select("query_id", "part")
    chosen = settled(each.join(head, ["query_id", "part"]).drop("bound"))
    first = settled(scored(chosen, index, k1, b))
    floors = first.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") == k).select("query_id", F.col("score").alias("floor"))
    others = sums.join(chosen.select("query_id", "part").distinct(), ["query_id", "part"], "left_anti").join(floors, "query_id", "left")
    reach = F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK)
    rest = scored(settled(each.join(others.where(reach).select("query_id", "part"), ["query_id", "part"]).drop("bound")), index, k1, b)
    return Search(first, rest, others.where(~reach).select("query_id", "part"))
