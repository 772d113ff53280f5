"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3, ...; by these weights they
share all words.  A target stops at ``MOST`` times its source's words, and what that frees is shared
again by weight until no target is above.  Within a source a document of n words has the inclusion weight
n / (n + ``SHORT``), so that fragments come less often; its expected number of copies is its source's
rate times that weight, at most ``MOST``, and the rate is such that the expected words are the target.
The whole part of that number is allocated with certainty; its fraction is the document's own inclusion
probability p.  Documents are ranked by (u / (1 - u)) / (p / (1 - p)) for a hashed uniform u, and the
first of a source are taken until their words come nearest to what the whole copies leave of the
target: first among texts of ``LONG`` words and more, for their part, then among the others for all
that is left, so that a source misses its target by less than half a text of under ``LONG`` words (by
more only where nearly all its words are in longer ones).  The cut of every source is found by two rounds of
histograms and one sort of the cut's own cell, so no source is ever ranked in one task.

Defined results: null texts have size 0; texts of size 0 are never taken; an empty table gives no
rows; rows equal in id and text are taken or left together; a source of size 0 has target 0; extra columns are kept.  More than ``MAX_SOURCES`` sources raise an error: their
totals are what reaches the driver and what is sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import text as X

MOST, SHORT, LONG = 3.0, 32, 512
MAX_SOURCES = 100_000
CELLS = 1024


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's share of all words by weight 1, 2, 3, ..., at most MOST times its own words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 0:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= MOST * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = MOST * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rate(target: float, cells: list[tuple[float, float]]) -> float:
    """The copies that a weight of one stands for, so that all expect ``target`` words; cells: (words, words times weight) of texts of like weight."""
    left, open_ = target, [(n, w) for n, w in cells if w > 0]
    while open_:
        found = max(left, 0.0) / sum(w for _, w in open_)
        full = [(n, w) for n, w in open_ if found * w >= MOST * n]
        if not full:
            return found
        left -= sum(MOST * n for n, _ in full)
        open_ = [x for x in open_ if x not in full]
    return float("inf")


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: str, text: str, seed: int) -> Column:
    """A hashed number strictly between 0 and 1."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.coalesce(F.col(text), F.lit(""))), 12)
    return (h.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def measured(docs: DataFrame, names: tuple[str, str], key: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """docs with two more columns: the size in words and the row's uniform number."""
    return docs.withColumn(names[0], size_of(text)).withColumn(names[1], uniform(key, text, seed))


def _cuts(rows: DataFrame, needs: dict[str, float]) -> dict[str, tuple[float, float]]:
    """rows: (s, size, x): for each source the greatest x that is taken and the words up to there.

    Only rows of sources reach the driver and are sent to every task.
    """
    spark = rows.sparkSession
    if not needs:
        return {}
    asked = spark.createDataFrame(list(needs.items()), "s string, need double").coalesce(1)
    scale = F.lit(float(CELLS * CELLS))
    rows = rows.withColumn("fine", F.floor(F.col("x") * scale).cast("long")).withColumn("coarse", F.floor(F.col("fine") / CELLS).cast("long"))

    def step(kind: str, data: DataFrame) -> DataFrame:
        sums = data.groupBy("s", "need", kind).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("s").orderBy(kind)))
        return X.settled(run.where("upto >= need and upto - n < need").select("s", kind, (F.col("need") - F.col("upto") + F.col("n")).alias("rest")), kind).withColumnRenamed("rest", "need")

    coarse = step("coarse", rows.join(F.broadcast(asked), "s"))
    fine = step("fine", rows.join(F.broadcast(coarse), ["s", "coarse"]))
    last = rows.join(F.broadcast(fine), ["s", "fine"])
    ranked = last.withColumn("upto", F.sum("size").over(W.partitionBy("s").orderBy("x", "size").rowsBetween(W.unboundedPreceding, 0)))
    inside = ranked.where("upto - size / 2 <= need").groupBy("s").agg(F.max("x").alias("x"), F.max("upto").alias("got"))
    below = F.col("fine").cast("double") / scale - F.lit(2.0**-40)
    found = fine.join(inside, "s", "left").select("s", F.coalesce("x", below).alias("x"), "need", F.coalesce("got", F.lit(0)).alias("got"))
    return {r["s"]: (r["x"], needs[r["s"]] - r["need"] + r["got"]) for r in found.collect()}


def source_rates(slim: DataFrame) -> DataFrame:
    """(s, source_size, target, rate) of every source; slim: (s, size).  A row a source, MAX_SOURCES at most."""
    spark = slim.sparkSession
    totals = slim.groupBy("s").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by = {r["s"]: r["n"] for r in totals}
    goal = targets({None if k == "n" else k[1:]: n for k, n in by.items()})
    table = spark.createDataFrame([(k, n, float(goal[None if k == "n" else k[1:]])) for k, n in by.items()], "s string, source_size long, target double").coalesce(1)
    cells = slim.where("size > 0").groupBy("s", F.floor(F.log2("size") * 2).alias("cell")).agg(F.sum("size").alias("n"), F.sum(F.col("size") * weight(F.col("size"))).alias("w"))
    rated = F.udf(lambda target, cells: rate(target, [(float(n), float(w)) for n, w in cells or []]), "double")
    # a source has some sixty cells at most
    listed = cells.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "w"))).alias("cells"))
    pairs = F.transform("cells", lambda c: F.struct(c["n"].cast("double"), c["w"]))
    return table.join(listed, "s", "left").select("s", "source_size", "target", rated("target", pairs).alias("rate"))


def weight(size: Column) -> Column:
    return size / (size + F.lit(float(SHORT)))


def rank(u: Column, p: Column) -> Column:
    """q / (1 + q) of the ratio q of the odds of u to those of p: the same order, between 0 and 1."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def mix(rows: DataFrame, size: str, u: str, source: str = "source") -> DataFrame:
    """rows with source_size, target and taken (words, repeats counted) and copies, by columns that ``measured`` made."""
    spark = rows.sparkSession
    # sources as text with null kept apart, so that they can be joined
    s = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    expected = lambda size, rate: F.when(size > 0, F.least(F.lit(MOST), rate * weight(size))).otherwise(F.lit(0.0))
    slim = X.settled(rows.select(s.alias("s"), F.col(size).alias("size"), F.col(u).alias("u")), "sizes")
    plan = X.settled(source_rates(slim), "rates")
    drawn = slim.join(F.broadcast(plan.select("s", "rate")), "s").withColumn("m", expected(F.col("size"), F.col("rate")))
    drawn = drawn.select("s", "size", (F.col("size") >= LONG).alias("long"), F.floor("m").alias("whole"), (F.col("m") - F.floor("m")).alias("p"), "u")
    sums = drawn.groupBy("s").agg(
        F.sum(F.col("whole") * F.col("size")).alias("certain"), F.sum(F.when(F.col("long"), F.col("p") * F.col("size"))).alias("long"), F.sum(F.when(~F.col("long") & (F.col("p") > 0), F.col("size"))).alias("open")
    )
    found = {r["s"]: r for r in plan.join(sums, "s").collect()}
    drawn = drawn.where("p > 0 and size > 0").select("s", "size", "long", rank(F.col("u"), F.col("p")).alias("x"))
    long_cuts = _cuts(drawn.where("long").drop("long"), {k: r["long"] for k, r in found.items() if r["long"]})
    needs = {k: r["target"] - r["certain"] - long_cuts.get(k, (0, 0))[1] for k, r in found.items()}
    cuts = _cuts(drawn.where("not long").drop("long"), {k: n for k, n in needs.items() if 0 < n < (found[k]["open"] or 0)})
    both = [(k, long_cuts[k][0] if k in long_cuts else -1.0, cuts[k][0] if k in cuts else 1.0 if n > 0 else -1.0) for k, n in needs.items()]
    full = plan.join(spark.createDataFrame(both, "s string, long double, other double").coalesce(1), "s", "left")
    with X.unused_names(rows, "s", "rate", "long", "other") as names:
        full = full.select(F.col("s").alias(names[0]), "source_size", "target", *(F.col(c).alias(n) for c, n in zip(("rate", "long", "other"), names[1:], strict=True)))
        keep = [c for c in rows.columns if c not in ("source_size", "target", "taken", "copies")]
        out = rows.select(*keep, s.alias(names[0])).join(F.broadcast(full), names[0], "left")
        m = expected(F.col(size), F.col(names[1]))
        p = m - F.floor(m)
        more = F.when((p > 0) & (rank(F.col(u), p) <= F.when(F.col(size) >= LONG, F.col(names[2])).otherwise(F.col(names[3]))), 1).otherwise(0)
        return out.withColumn("copies", (F.floor(m) + more).cast("int")).withColumn("taken", (F.col("copies") * F.col(size)).cast("long")).select(*keep, "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """(key, size, source_size, target, taken, copies) of every document."""
    slim = X.settled(measured(docs.select(key, text, source), ("size", "u_"), key, text, seed).select(key, source, "size", "u_"), "measured")
    return mix(slim, "size", "u_", source).select(key, "size", "source_size", "target", "taken", "copies")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    # the rows go along as one value, so that none of their columns meets the mix's own
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    mixed = mix(measured(rows, ("size", "u"), "key", "text", seed).select("row", "source", "size", "u"), "size", "u")
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
