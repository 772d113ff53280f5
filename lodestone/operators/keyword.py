"""Weighted keyword matching of free text against curated entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import matching
from lodestone.operators.retrieval import small

#: What a model is shown of an entry; points for a keyword, a tag and the title.
TOOL_FIELDS = ("id", "title", "theory_source", "one_liner", "tags")
POINTS = {"keyword": 3, "tag": 2, "title": 1}


def terms(entries: DataFrame) -> DataFrame:
    """entries (entry_id, pos, title, tags, trigger_keywords) -> (entry_id, pos, term, points), empty terms out."""
    parts = [(F.explode("trigger_keywords"), "keyword"), (F.explode("tags"), "tag"), (F.col("title"), "title")]
    frames = [entries.select("entry_id", "pos", e.alias("raw"), F.lit(POINTS[kind]).alias("points")) for e, kind in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).where("raw <> ''").select("entry_id", "pos", fx.normalise(F.col("raw")).alias("term"), "points")


def match(inputs: DataFrame, entries: DataFrame, k: int = 3) -> DataFrame:
    """inputs (input_id, text) -> (input_id, rank, entry_id, score): every term contained in the input scores once.

    One automaton finds all terms in one pass over a text.  A term of white space alone is in every input that has text.
    """
    known, asked = terms(entries), inputs.select(F.col("input_id").alias("id"), fx.normalise(F.col("text")).alias("t"))
    found = matching.contained(asked, known).unionByName(asked.where("t <> ''").select("id", F.lit("").alias("term")))
    hits = found.withColumnRenamed("id", "input_id").join(small(known, 50_000), "term").groupBy("input_id", "entry_id", "pos").agg(F.sum("points").alias("score"))
    order = W.partitionBy("input_id").orderBy(F.desc("score"), "pos")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("input_id", "rank", "entry_id", "score")


def with_fallback(inputs: DataFrame, matched: DataFrame, fallback: list[str]) -> DataFrame:
    """Inputs without a match get the fixed entries in fixed order with score 0."""
    lost = inputs.join(matched.select("input_id").distinct(), "input_id", "left_anti")
    rows = lost.select("input_id", F.posexplode(F.array(*[F.lit(f) for f in fallback])).alias("p", "entry_id"))
    return matched.unionByName(rows.select("input_id", (F.col("p") + 1).alias("rank"), "entry_id", F.lit(0).cast("long").alias("score")))


def dispatch(answers: DataFrame, entries: DataFrame, score: int = 100) -> DataFrame:
    """answers (input_id, ids array) of a model -> its entries in its order, unknown ids dropped."""
    flat = answers.select("input_id", F.posexplode("ids").alias("p", "entry_id")).join(entries.select("entry_id"), "entry_id")
    order = W.partitionBy("input_id").orderBy("p")
    return flat.select("input_id", F.row_number().over(order).alias("rank"), "entry_id", F.lit(score).alias("score"))


def answered(inputs: DataFrame, answers: DataFrame, entries: DataFrame, fallback: list[str], k: int = 3) -> DataFrame:
    """inputs (input_id, text), answers (input_id, ids, error) of a model -> (input_id, rank, entry_id, score, by).

    What the model named; where it failed, did not answer or named nothing that is known, the local match; without one the fixed entries.
    """
    named = dispatch(answers.where("error is null"), entries).withColumn("score", F.col("score").cast("long"))
    left = inputs.join(named.select("input_id").distinct(), "input_id", "left_anti")
    local = match(left, entries, k)
    both = with_fallback(left, local, fallback)
    return named.withColumn("by", F.lit("model")).unionByName(both.withColumn("by", F.when(F.col("score") > 0, "match").otherwise("fallback")))


def excerpts(entries: DataFrame) -> DataFrame:
    """(id, place, text, source, url) of every quoted passage."""
    return entries.select("id", F.posexplode("original_excerpts").alias("place", "x")).select("id", "place", "x.*")


def readings(entries: DataFrame) -> DataFrame:
    """(id, place, title, url) of every further reading."""
    return entries.select("id", F.posexplode("further_reading").alias("place", "x")).select("id", "place", "x.*")


def tool_list(entries: DataFrame, order: str = "id") -> DataFrame:
    """One row: what a model is shown of all curated entries, as one JSON list of five fields each."""
    shown = F.struct(*TOOL_FIELDS)
    return entries.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("s")))), lambda x: x["s"])).alias("tools"))


def personalised(fields: list[str], own: str = "own_", fixed: str = "") -> list:
    """For each field the personal value if it is not empty, else the entry's."""
    return [F.coalesce(F.nullif(F.col(own + f), F.lit("")), F.col(fixed + f)).alias(f) for f in fields]


def cards(entries: DataFrame, most: int = 5) -> DataFrame:
    """Entries as a browser lists them: their first tags only."""
    return entries.withColumn("tags", F.slice("tags", 1, most))
