"""The ingest job: pages to articles to chunks to vectors, each stage a table that the next one reads.

    spark-submit --py-files lodestone.zip lodestone/job.py PAGES OUT [--skip-clean] [--skip-chunk] [--skip-embed] [--skip-verify] [--restart]

A stage writes by the job-commit protocol, so a lost executor costs its tasks and a lost driver its
stage.  The embedding stage writes in parts and goes on after the last, unless it is told to restart.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, cleaning, embedding
from lodestone.sources import store


def cleaned(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (article_id, url, markdown with its head, warnings, ratio_ok)."""
    raw = cleaning.markdown(pages, keep=("url", "html")).withColumn("raw", cleaning.collapse_blanks(F.col("md")))
    body = raw.withColumn("led", cleaning.trim_leading(F.col("raw"))).withColumn("body", cleaning.trim_trailing(F.col("led")))
    head = cleaning.frontmatter(id=F.col("page_id"), source=F.col("url"))
    return body.select(
        F.col("page_id").cast("string").alias("article_id"),
        "url",
        F.concat(head, "body").alias("markdown"),
        cleaning.warnings(F.col("raw"), F.col("body"), F.col("tables")).alias("warnings"),
        cleaning.ratio_ok(F.col("body"), F.col("html")).alias("ratio_ok"),
    )


#: chunks whose vectors are written together: what a pass that dies loses at most
PART_ROWS = 5_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def embed(spark: SparkSession, chunks: DataFrame, path: str, restart: bool = False) -> DataFrame:
    """Vectors of the chunks that the table at path lacks are added to it; raises unless they then match one to one."""
    going_on = not restart and _exists(spark, path)
    parts = max(1, -(-chunks.count() // PART_ROWS))
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    for part in range(parts):
        some = chunks.where(share == part)
        todo = embedding.remaining(some, spark.read.parquet(path)) if going_on else some
        embedding.embed(todo).write.mode("append" if going_on else "overwrite").parquet(path)
        going_on = True
    vectors = spark.read.parquet(path)
    embedding.check_bijection(chunks, vectors)
    return vectors


def run(spark: SparkSession, pages: str, out: str, skip: frozenset[str] = frozenset(), restart: bool = False) -> None:
    if "clean" not in skip:
        cleaned(spark.read.parquet(pages)).write.mode("overwrite").parquet(f"{out}/articles")
    if "chunk" not in skip:
        articles = spark.read.parquet(f"{out}/articles")
        chunking.chunk_articles(articles, "article_id", "markdown").write.mode("overwrite").parquet(f"{out}/chunks")
    if "embed" not in skip:
        embed(spark, spark.read.parquet(f"{out}/chunks"), f"{out}/vectors", restart)
    if "verify" not in skip:
        verify(spark, out)


def verify(spark: SparkSession, out: str, n: int = 10) -> None:
    """Writes the totals of the chunks and ``n`` articles for a reader; raises unless chunks and vectors match."""
    articles, chunks = spark.read.parquet(f"{out}/articles"), spark.read.parquet(f"{out}/chunks")
    if _exists(spark, f"{out}/vectors"):
        embedding.check_bijection(chunks, spark.read.parquet(f"{out}/vectors"))
    chunking.stats(chunks).write.mode("overwrite").json(f"{out}/stats")
    store.spot_check(articles, n, key="article_id").write.mode("overwrite").json(f"{out}/sample")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("pages")
    args.add_argument("out")
    for stage in ("clean", "chunk", "embed", "verify"):
        args.add_argument(f"--skip-{stage}", dest="skip", action="append_const", const=stage)
    args.add_argument("--restart", action="store_true")
    given = args.parse_args()
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    run(spark, given.pages, given.out, frozenset(given.skip or ()), given.restart)
    spark.stop()


if __name__ == "__main__":
    main()
