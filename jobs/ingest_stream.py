"""Takes new and changed articles of a growing folder into a table of chunks, and leaves the rest alone.

    spark-submit --py-files lodestone.zip jobs/ingest_stream.py INPUT OUT CHECKPOINT [--config jobs/ingest_stream.json]

A file stream hands over the files that no earlier run has taken (the checkpoint knows them) and stops when there are no more.
Of their rows only those go on whose text differs from the article's last one.  Three tables grow, all in folders by batch:

    OUT/articles  id, text_hash, volume                 by batch
    OUT/chunks    the chunks of those articles          by batch and volume
    OUT/vectors   chunk_id, embedding, one for a chunk  by batch

A batch that is run again, after a crash at any point, overwrites its own folders and no others, and compares its rows with earlier
batches only, so it ends in the same tables.  ``current`` reads each article's chunks of its last batch.

Defined results: null and empty texts are articles without chunks; null ids are one article; of several rows of one id in one
batch the greatest text counts; equal rows count once; further columns are not read; an empty input leaves empty tables.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import chunking, embedding
from lodestone.operators.retrieval import small
from lodestone.sources.layout import SPREAD_BYTES

log = logging.getLogger("lodestone.ingest_stream")
ARTICLES = "id string, text_hash string, volume string, batch long"
CHUNKS = f"{chunking.CHUNK}, batch long, volume string"
VECTORS = "chunk_id string, embedding array<float>, batch long"


@dataclass(frozen=True)
class Config:
    key: str = "doc_id"
    text: str = "text"
    volume: str = "lang"
    files_per_batch: int = 64
    embedder: str = "local"
    sizes: chunking.Sizes = field(default_factory=chunking.Sizes)


def config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return Config(**given | {"sizes": chunking.Sizes(**given.get("sizes", {}))})


def _last(articles: DataFrame) -> DataFrame:
    """Each article's last version; at most one row of a batch has its id."""
    return articles.groupBy("id").agg(F.max_by("text_hash", "batch").alias("text_hash"), F.max("batch").alias("batch"))


def one_each(rows: DataFrame) -> DataFrame:
    """rows (id, text, text_hash, volume), the greatest of each id; only rows of ids that several have are shuffled with their texts."""
    several = rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("of"))
    same = rows["id"].eqNullSafe(several["of"])
    first = W.partitionBy("id").orderBy(F.desc_nulls_last("text"), F.desc_nulls_last("volume"))
    others = rows.join(several, same, "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.join(several, same, "left_anti").unionByName(others)


def take(batch: DataFrame, number: int, out: str, conf: Config) -> int:
    """Adds the new and changed articles of one batch; the same input and number give the same folders.  Returns the rows taken."""
    spark = batch.sparkSession
    hashed = F.sha2(F.coalesce(F.col(conf.text), F.lit("")).cast("binary"), 256)
    rows = batch.select(F.col(conf.key).cast("string").alias("id"), F.col(conf.text).alias("text"), hashed.alias("text_hash"), F.col(conf.volume).cast("string").alias("volume"))
    n, ids, size = rows.agg(F.count("*"), F.countDistinct(F.struct("id")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = rows if n == ids else one_each(rows)
    earlier = _last(spark.read.schema(ARTICLES).parquet(f"{out}/articles").where(F.col("batch") < number)).select(F.col("id").alias("had"), F.col("text_hash").alias("had_hash"))
    fresh = rows.join(earlier, F.col("id").eqNullSafe(F.col("had")) & (F.col("text_hash") == F.col("had_hash")), "left_anti")
    _write(fresh.select("id", "text_hash", "volume", F.lit(number).cast("long").alias("batch")), f"{out}/articles", "batch")
    # what was just listed is what is cut, so both tables hold the same articles
    listed = spark.read.schema(ARTICLES).parquet(f"{out}/articles").where(F.col("batch") == number).select(F.col("id").alias("of"))
    taken = listed.count()
    # if all articles are listed there is nothing to leave out, and no text is shuffled
    chosen = rows if taken == ids else rows.join(small(listed), F.col("id").eqNullSafe(F.col("of")), "left_semi")
    cores = spark.sparkContext.defaultParallelism
    # a stream's files are not known to spread()
    chosen = chosen.repartition(cores) if size <= cores * SPREAD_BYTES else chosen
    cut = chunking.chunk_articles(chosen, "id", "text", conf.sizes, keep=("volume",))
    _write(cut.withColumn("batch", F.lit(number).cast("long")), f"{out}/chunks", "batch", "volume")
    chunks = spark.read.schema(CHUNKS).parquet(f"{out}/chunks").where(F.col("batch") == number)
    _write(embedding.embed(chunks, conf.embedder).withColumn("batch", F.lit(number).cast("long")), f"{out}/vectors", "batch")
    log.info("batch %d: %d rows read, %d articles new or changed, %d chunks with vectors written to %s", number, n, taken, chunks.count(), out)
    return n


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, conf: Config = Config()) -> int:
    """Takes all files of ``source`` that no run with this checkpoint has taken; returns how many rows they had."""
    for name, schema in (("articles", ARTICLES), ("chunks", CHUNKS), ("vectors", VECTORS)):
        # the folders are there before the first batch reads them; nothing is added
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{out}/{name}")
    columns = list(dict.fromkeys((conf.key, conf.text, conf.volume)))
    schema = spark.read.parquet(source).select(*columns).schema
    # a pattern that fits this path only: unlike a plain path it may be one file as well as a folder of them
    path = source.rstrip("/")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", conf.files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    taken: list[int] = []
    stream = rows.writeStream.foreachBatch(lambda batch, number: taken.append(take(batch, number, out, conf))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %d new rows of %s", sum(taken), source)
    return sum(taken)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every article as it was last delivered: all but those of versions that a later batch replaced, which are few."""
    listed = spark.read.schema(ARTICLES).parquet(f"{out}/articles").select("id", "batch")
    old = listed.withColumn("last", F.max("batch").over(W.partitionBy("id"))).where("batch < last").select(F.col("id").alias("of"), F.col("batch").alias("of_batch"))
    chunks = spark.read.schema(CHUNKS).parquet(f"{out}/chunks")
    return chunks.join(small(old), chunks["article_id"].eqNullSafe(F.col("of")) & (chunks["batch"] == F.col("of_batch")), "left_anti")


def vectors(spark: SparkSession, out: str) -> DataFrame:
    """(chunk_id, embedding) of those chunks."""
    known = current(spark, out).select(F.col("chunk_id").alias("of"), F.col("batch").alias("of_batch"))
    table = spark.read.schema(VECTORS).parquet(f"{out}/vectors")
    return table.join(known, table["chunk_id"].eqNullSafe(known["of"]) & (table["batch"] == known["of_batch"]), "left_semi").drop("batch")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("source", "out", "checkpoint"):
        args.add_argument(name)
    args.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "ingest_stream.json"))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_stream").getOrCreate()
    try:
        run(spark, given.source, given.out, given.checkpoint, config(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
