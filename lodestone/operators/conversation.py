"""Chat histories, context blocks, citations and typed event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as fx

#: The title of a text before any heading, and how titles are cited.
INTRODUCTION = "(引言)"
#: The block of passages that a model reads, and what it says where there are none.
BLOCK, BLOCK_END, NOTE_TAG = "<retrieved_theory>", "</retrieved_theory>", " (注释)"
NO_PASSAGES = "(无相关原文 — 如无法引用,请直接做方法分析和行动建议)"
CITED = r"《([^》\n]+)》"


def latest_user(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("latest"))


def validity(turns: DataFrame) -> DataFrame:
    """A conversation can be answered if its last turn is the user's."""
    return turns.groupBy("conv_id").agg((F.max_by("role", "turn") == "user").alias("valid"))


def section(title: Column, footnote: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit(INTRODUCTION)), F.when(footnote, F.lit(" [footnote]")).otherwise(F.lit("")))


def context_block(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """queries (query_id), ranked (query_id, rank, title, section, is_footnote, text, source_url) -> (query_id, block) of every query:
    numbered passages in order, each with its title, section, footnote tag and source."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 《"), "title", F.lit("》 · "), F.coalesce(F.nullif("section", F.lit("")), F.lit(INTRODUCTION)), F.when(F.col("is_footnote"), NOTE_TAG).otherwise(""))
    passage = F.concat_ws("\n", head, fx.strip(F.col("text")), F.concat(F.lit("source: "), F.coalesce("source_url", F.lit(""))), F.lit(""))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", passage.alias("s")))), lambda x: x["s"])
    blocks = ranked.groupBy("query_id").agg(F.array_join(lines, "\n").alias("inside"))
    return queries.select("query_id").distinct().join(blocks, "query_id", "left").select("query_id", F.concat_ws("\n", F.lit(BLOCK), F.coalesce("inside", F.lit(NO_PASSAGES)), F.lit(BLOCK_END)).alias("block"))


def candidate_lines(ranked: DataFrame, n: int = 300) -> DataFrame:
    """The numbered list that a reranker reads, numbers from 0."""
    line = F.concat(F.lit("["), (F.col("rank") - 1).cast("string"), F.lit("] "), section(F.col("section"), F.col("is_footnote")), F.lit(": "), fx.preview(F.col("text"), n))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("s")))), lambda x: x["s"])
    return ranked.groupBy("query_id").agg(F.concat_ws("\n", lines).alias("candidates"))


def prompt(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """History without its last turn, then that turn with its context block (conv_id -> block) before it."""
    last = W.partitionBy("conv_id")
    marked = turns.withColumn("end", F.max("turn").over(last)).join(blocks, "conv_id", "left")
    text = F.when(F.col("turn") == F.col("end"), F.concat_ws("\n\n", "block", "text")).otherwise(F.col("text"))
    return marked.select("conv_id", "turn", "role", text.alias("text"))


def citations(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """answers (query_id, answer), titles (query_id, rank, title) -> (query_id, pos, title, active)."""
    found = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(CITED), F.lit(1))).alias("pos", "title"))
    known = titles.select("query_id", "title").distinct().withColumn("there", F.lit(True))
    return found.join(known, ["query_id", "title"], "left").select("query_id", "pos", "title", F.coalesce("there", F.lit(False)).alias("active"))


def cited_sources(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct retrieved titles that the answer cites, in order of retrieval."""
    both = titles.groupBy("query_id", "title").agg(F.min("rank").alias("rank")).join(answers, "query_id")
    return both.where(F.contains("answer", F.concat(F.lit("《"), F.col("title"), F.lit("》")))).select("query_id", "rank", "title")


def popovers(titles: DataFrame, most: int = 2, n: int = 200) -> DataFrame:
    """The first passages of each title, shortened."""
    order = W.partitionBy("query_id", "title").orderBy("rank")
    return titles.withColumn("p", F.row_number().over(order)).where(F.col("p") <= most).select("query_id", "title", "p", F.substring("text", 1, n).alias("text"))


def sse(kind: Column, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))), F.lit("\n\n"))


def read_sse(stream: DataFrame, column: str, schema: str, *keep: str) -> DataFrame:
    """(keep, seq, event) of a text column of frames; frames without a readable data line are dropped."""
    frames = stream.select(*keep, F.posexplode(F.split(column, "\n\n")).alias("seq", "frame"))
    lines = frames.select(*keep, "seq", F.regexp_extract("frame", r"(?m)^data: (.*)$", 1).alias("line"))
    return lines.where(F.json_object_keys("line").isNotNull()).select(*keep, "seq", F.from_json("line", schema).alias("event"))


def events(queries: DataFrame, chunks: DataFrame, deltas: DataFrame) -> DataFrame:
    """The typed event rows (query_id, seq, type, payload) of every query.

    queries (query_id, failed, message): failed is null, or the step that failed: 'request' or 'retrieval', after which there is
    nothing but the error, or 'generation', which ends what was written so far.  Else all ends with done.  Empty deltas are no events.
    """
    going = queries.where("failed is null or failed = 'generation'").select("query_id")
    shown = chunks.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rank", *[c for c in chunks.columns if c not in ("query_id", "rank")])))).alias("payload"))
    first = going.join(shown, "query_id", "left").select("query_id", F.lit(0).alias("seq"), F.lit("retrieved").alias("type"), F.coalesce("payload", F.lit("[]")).alias("payload"))
    middle = deltas.where("delta <> ''").join(going, "query_id", "left_semi").select("query_id", (F.col("pos") + 1).alias("seq"), F.lit("text_delta").alias("type"), F.col("delta").alias("payload"))
    length = middle.groupBy("query_id").agg(F.max("seq").alias("n"))
    error = F.col("failed").isNotNull()
    at = F.when(F.coalesce(F.col("failed"), F.lit("")).isin("request", "retrieval"), 0).otherwise(F.coalesce("n", F.lit(0)) + 1)
    last = queries.join(length, "query_id", "left").select("query_id", at.alias("seq"), F.when(error, "error").otherwise("done").alias("type"), F.when(error, F.col("message")).alias("payload"))
    return first.unionByName(middle).unionByName(last)
