"""Readers, writers and keyed updates of the corpus files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.layout import scratch, spread  # noqa: F401

ARTICLE = "id string, stable_slug string, title string, year int, month int, category string, url_primary string, provider string, status string, raw_size long, clean_size long, error string"
MANIFEST = f"volumes array<struct<volume: int, articles: array<struct<{', '.join(': '.join(f.split(' ')) for f in ARTICLE.split(', '))}>>>>"
CHUNK = "chunk_id string, text string, article_id string, article_title string, stable_slug string, source_url string, upstream_provider string, section_title string, footnote_ref string, char_count int, volume int, year int, char_offset_start int, char_offset_end int, month int, is_footnote boolean, section_title_is_descriptive boolean"
ENTRY = "id string, title string, theory_source string, one_liner string, modern_interpretation string, caveats string, tags array<string>, trigger_keywords array<string>, action_checklist array<string>, original_excerpts array<struct<text: string, source: string, url: string>>, analogy_story struct<title: string, body: string>, further_reading array<struct<title: string, url: string>>"


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The nested manifest, one document over many lines or a document a line; Spark's reader raises if it is missing."""
    return spark.read.option("multiLine", not lines).schema(MANIFEST).json(path)


def articles(manifest: DataFrame) -> DataFrame:
    """(volume, every field of the article)."""
    v = manifest.select(F.explode("volumes").alias("v"))
    return v.select(F.col("v.volume").alias("volume"), F.explode("v.articles").alias("a")).select("volume", "a.*")


def nested(flat: DataFrame, most: int = 1_000) -> DataFrame:
    """Flat articles as a manifest again: rows of one volume and about ``most`` of its articles, so that no row grows with the corpus."""
    fields = [c for c in flat.columns if c != "volume"]
    parts = max(1, -(-flat.count() // most))
    lists = flat.groupBy("volume", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("articles"))
    return lists.select(F.array(F.struct("volume", "articles")).alias("volumes"))


def write_json(df: DataFrame, path: str) -> None:
    """Written by the job-commit protocol: readers see all or nothing of a task."""
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def update(rows: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """rows with the non-null fields of changes; KeyError if a change has no row.

    Several changes of one row need an order: the last non-null value of each field holds.
    """
    if order:
        fields = [c for c in changes.columns if c not in (key, order)]
        changes = changes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])
    elif not changes.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"several changes of one {key} need an order")
    if not changes.join(rows, key, "left_anti").isEmpty():
        raise KeyError(f"changes for an unknown {key}")
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    merged = rows.join(new, key, "left")
    out = [F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns]
    return merged.select(*out, *[F.col(f"new_{c}").alias(c) for c in fields if c not in rows.columns])


def worklist(rows: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """What is still to be fetched."""
    todo = rows.where("status is null or status <> 'downloaded'")
    return todo.where(F.col("id").isin(*ids)) if ids else todo


def crawl_results(fetched: DataFrame, clean: str = "clean") -> DataFrame:
    """fetched (id, html, clean, error, warnings) -> (id, status, raw_size, clean_size, ratio, error, warnings).

    raw_size counts bytes and clean_size characters; a ratio out of bounds is one more warning.
    """
    done = F.col("error").isNull() & F.col("html").isNotNull()
    raw, size = F.octet_length("html").cast("long"), F.length(clean).cast("long")
    ratio = F.when(done & (raw > 0), size / raw)
    odd = F.when(~ratio.between(0.15, 0.50), F.array(F.concat(F.lit("compression ratio "), F.format_number(F.round(ratio * 100, 1), 1), F.lit("% outside [15%, 50%]"))))
    return fetched.select(
        "id",
        F.when(done, "downloaded").otherwise("failed").alias("status"),
        F.when(done, raw).alias("raw_size"),
        F.when(done, size).alias("clean_size"),
        ratio.alias("ratio"),
        F.when(~done, F.coalesce("error", F.lit("no page"))).alias("error"),
        F.when(done, F.concat(F.coalesce("warnings", F.array()), F.coalesce(odd, F.array()))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


#: folders of raw pages
FOLDERS = 16


def write_raw(pages: DataFrame, path: str, key: str) -> None:
    """Pages with their bytes, in folders by a hash of the key, so that a page is found again in one of them."""
    pages.withColumn("folder", F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")).write.mode("overwrite").partitionBy("folder").parquet(path)


def decoded(raw: Column, charset: str = "gb18030", other: str = "utf-8") -> Column:
    """Text of page bytes: by the charset, or if it cannot read them by the other, or if that cannot either by the charset with
    replacement characters.  (Spark's own decode knows no GB18030.)"""

    def read(b: bytes | None) -> str | None:
        if b is None:
            return None
        for kind in (charset, other):
            try:
                return bytes(b).decode(kind)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode(charset, "replace")

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(read)

    return text(raw)


def encoded(text: Column, charset: str = "gb18030") -> Column:
    """Page bytes of a text."""

    @F.pandas_udf("binary")
    def raw(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode(charset))

    return raw(text)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; fields that a line lacks are null."""
    return spark.read.schema(CHUNK).json(path)


def chunk_lookup(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked (chunk_id) -> the eleven fields that a reader is shown of each chunk; ``there`` is false where there is none."""
    fields = ["text", "article_id", "article_title", "section_title", "section_title_is_descriptive", "footnote_ref", "source_url", "char_offset_start", "char_offset_end"]
    known = chunks.select("chunk_id", *fields, F.coalesce("is_footnote", F.lit(False)).alias("is_footnote"), F.lit(True).alias("there"))
    return asked.join(known, "chunk_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def result(chunks: DataFrame, score: Column) -> DataFrame:
    """Chunk rows as a search returns them: without their size, with a score."""
    return chunks.withColumn("score", score.cast("double")).drop("char_count")


def write_entries(entries: DataFrame, path: str) -> None:
    """JSON lines, an entry each."""
    entries.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_entries(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Entries of JSON lines, or of one array over many lines."""
    return spark.read.option("multiLine", not lines).schema(ENTRY).json(path)


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """(query, pos, rewrite) of JSON maps, one over many lines or one a line; a missing or unreadable file is an empty cache."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    text = spark.read.text(path, wholetext=True) if found else spark.createDataFrame([], "value string")
    maps = text.select(F.explode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("value"))
    return maps.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("query", "rs")).select("query", F.posexplode("rs").alias("pos", "rewrite"))


def write_rewrites(cache: DataFrame, path: str) -> None:
    """cache (query, pos, rewrite) as JSON lines, a map of one query each, which ``read_rewrites`` reads back."""
    lists = cache.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rewrite"))), lambda x: x["rewrite"]).alias("rs"))
    lists.select(F.to_json(F.create_map("query", "rs")).alias("value")).write.mode("overwrite").text(path)


def article_body(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"\A---\n(?s:.*?)\n---\n", "")


def listing(rows: DataFrame) -> DataFrame:
    return rows.select("id", "volume", "title", "year", "month", "category", "url_primary", "provider", F.coalesce("status", F.lit("pending")).alias("status"))


def lookup(asked: DataFrame, rows: DataFrame, *fields: str) -> DataFrame:
    """asked (id) -> (id, outcome, fields): found, unknown or not downloaded; only what is found shows its fields."""
    known = rows.select("id", "status", *fields).withColumn("there", F.lit(True))
    found = F.coalesce(F.col("status") == "downloaded", F.lit(False))
    outcome = F.when(F.col("there").isNull(), "unknown").when(~found, "not downloaded").otherwise("found")
    return asked.join(known, "id", "left").select("id", outcome.alias("outcome"), *[F.when(found, F.col(f)).alias(f) for f in fields])


def health(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: articles, downloaded articles, chunks."""
    a = rows.agg(F.count("*").alias("articles"), F.count_if(F.col("status") == "downloaded").alias("downloaded"))
    return a.crossJoin(chunks.agg(F.count("*").alias("chunks")))


def spot_check(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows, the same for a seed."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
