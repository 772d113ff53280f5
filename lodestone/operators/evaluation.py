"""Retrieval quality: hit@k, MRR, negatives, attractors, diversity, and reports over several retrievers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import matching
from lodestone.operators.retrieval import small
from lodestone.sources.layout import kept, spread


#: tokens of a seed
SEED = 3


def _runs(tokens: Column) -> Column:
    """A hash of each run of SEED neighbouring tokens, each once."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (SEED - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(tokens, (i + k).cast("int")) for k in range(SEED)]))
    return F.array_distinct(F.when(F.size(tokens) >= SEED, hashed).otherwise(F.array().cast("array<long>")))


def seeds(passages: DataFrame, docs: DataFrame, few: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """passages (query_id, passage), docs (id, text) -> (hits (id, run), chosen (query_id, passage, run)).

    A document that holds a passage holds all runs of its inner tokens, so each passage's rarest run finds all its holders; a passage with
    a run that no document has is left out.
    """
    inner = passages.select("query_id", "passage", fx.tokens(F.col("passage")).alias("ts")).select("query_id", "passage", F.slice("ts", F.lit(2), F.greatest(F.size("ts") - 2, F.lit(0))).alias("ts"))
    asked = kept(inner.select("query_id", "passage", F.explode(_runs(F.col("ts"))).alias("run")), "runs")
    words = spread(docs).select("id", fx.tokens(F.col("text")).alias("ts")).select("id", F.explode(_runs(F.col("ts"))).alias("run"))
    hits = kept(words.join(small(asked.select("run").distinct(), few), "run", "left_semi").select("id", "run"), "hits")
    often = hits.groupBy("run").agg(F.count("*").alias("n"))
    chosen = asked.join(small(often, few), "run", "left").groupBy("query_id", "passage").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    return hits, chosen.where("n > 0").select("query_id", "passage", "run")


def holders(passages: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", few: int = 200_000) -> DataFrame:
    """(query_id, id): which documents hold which passages (query_id, passage) word for word.

    Only documents with a passage's rarest run of inner tokens are compared with it, so a word that all documents hold costs
    nothing; passages too short for a run are looked for by one automaton.  Null and empty passages are held by none.
    """
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    hits, chosen = seeds(passages, texts, few)
    pairs = hits.join(small(chosen, few), "run").select("id", "query_id", "passage")
    found = texts.join(small(pairs, few), "id").where(F.contains("text", "passage")).select("query_id", "id")
    short = passages.where(F.size(fx.tokens(F.col("passage"))) < SEED + 2).select("query_id", F.col("passage").alias("term"))
    held = matching.contained(texts.withColumnRenamed("text", "t"), short).join(small(short, few), "term").select("query_id", "id")
    return found.unionByName(held).distinct()


def named(results: dict[str, DataFrame]) -> DataFrame:
    """(retriever, query_id, rank, id) of several rankings."""
    return reduce(DataFrame.unionByName, [found.select(F.lit(name).alias("retriever"), "query_id", "rank", "id") for name, found in results.items()])


def first_hits(gold: DataFrame, results: DataFrame, names: list[str] | None = None) -> DataFrame:
    """gold (query_id, id) and results (query_id, rank, id) -> (query_id, first) of every query that has an answer, null if it was not found.

    With ``names`` results hold several rankings by their ``retriever``, and each has a row for every such query.
    """
    by = ["retriever", "query_id"] if names else ["query_id"]
    hit = results.join(gold, ["query_id", "id"]).groupBy(*by).agg(F.min("rank").alias("first"))
    asked = gold.select("query_id").distinct()
    if names:
        asked = asked.withColumn("retriever", F.explode(F.array(*map(F.lit, names))))
    return asked.join(hit, by, "left")


def report(gold: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """One metrics row for each named ranking, of zeros if no query has an answer."""
    names = list(results)
    found = metrics(first_hits(gold, named(results), names), by=("retriever",))
    every = gold.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("retriever"))
    return every.join(found, "retriever", "left").fillna(0).select(found.columns)


def metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group: hits at each k and the mean reciprocal rank, over all queries of ``ranks``."""
    hits = [F.round(F.coalesce(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f"hit_at_{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count("*").alias("queries"), *hits, F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))


def negatives(cases: DataFrame, results: DataFrame, within: int = 5) -> DataFrame:
    """(query_id, ok, offender): whether no unwanted title is among the first, and the first that is."""
    bad = (F.col("rank") <= within) & F.exists("anti_expected", lambda e: F.contains(F.col("title"), e))
    out = cases.join(results, "query_id", "left").groupBy("query_id").agg(F.min(F.when(bad, F.struct("rank", "title"))).alias("b"))
    return out.select("query_id", F.col("b").isNull().alias("ok"), F.col("b.title").alias("offender"))


def attractors(results: DataFrame, within: int = 5, least: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, queries): what comes early for many queries."""
    return results.where(F.col("rank") <= within).groupBy(*by, "id").agg(F.countDistinct("query_id").alias("queries")).where(F.col("queries") >= least)


def diversity(results: DataFrame, group: str, within: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group: how many sources a query's first results come from, on average."""
    per = results.where(F.col("rank") <= within).groupBy(*by, "query_id").agg(F.countDistinct(group).alias("n"))
    return per.groupBy(*by).agg(F.round(F.avg("n"), 6).alias("mean_groups"), F.count("*").alias("queries"))


def cost(usage: DataFrame, prices: dict[str, float]) -> DataFrame:
    """usage (kind, tokens) -> total price, at a price for a million tokens of each kind."""
    table = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return usage.agg(F.round(F.sum(F.col("tokens") * F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(0.0)) / 1e6), 6).alias("price"))
