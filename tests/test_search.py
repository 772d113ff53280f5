"""Blocked vector search, block-max search, the automaton and the gap-split limiter: against plain versions, and by their plans."""

import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import keyword, matching, postings, retrieval, vectors
from lodestone.streaming import ratelimit


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nearest(queries, rows, k):
    """By scores rounded to six places, then by id."""
    out = {}
    for q, v in queries:
        fit = [(-round(float(np.dot(np.float64(v), np.float64(w))), 6), i) for i, w in rows if w is not None and v is not None and len(w) == len(v) and len(v) and None not in w and None not in v and np.isfinite(w).all()]
        out[q] = [i for _, i in sorted(fit)[:k]]
    return out


@pytest.mark.parametrize("most_queries", [20_000, 3])
def test_dense_by_blocks(spark, monkeypatch, most_queries):
    """Ties, nulls, other lengths, more queries than are sent: the same as one pair at a time."""
    monkeypatch.setattr(vectors, "MOST_QUERIES", most_queries)
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(700)] + [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, 2.0]), (904, [float("nan")] * 4), (905, [0.0] * 4)]
    asked = [(f"q{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(30)] + [("none", None), ("two", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    qs = spark.createDataFrame(asked, "query_id string, vector array<float>")
    got = {}
    for r in retrieval.dense(qs, df, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = nearest(asked, rows, 7)
    assert got == {q: ids for q, ids in want.items() if ids}
    stored = retrieval.vector_blocks(df)
    assert retrieval.dense(qs, df, k=7, stored=stored).exceptAll(retrieval.dense(qs, df, k=7)).isEmpty()
    assert retrieval.dense(qs, df.limit(0), k=7).count() == retrieval.dense(qs.limit(0), df, k=7).count() == 0


def test_dense_plan_has_no_pairs(spark):
    """What is joined are blocks and tiles: the rows that reach a product are as many as blocks times tiles."""
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(8)]).alias("embedding"))
    qs = spark.range(500).select(F.col("id").alias("query_id"), F.array(*[F.rand(90 + i) for i in range(8)]).alias("vector"))
    stored = retrieval.vector_blocks(df)
    n = stored.count()
    assert n < 40 and stored.agg(F.max(F.size("ids"))).first()[0] <= vectors.BLOCK
    plan = plan_of(retrieval.dense(qs, df, k=5))
    assert "ids#" in plan and "matrix#" in plan and "zip_with" not in plan


def test_a_row_group_for_each_vector_block(spark, tmp_path):
    rows = spark.range(0, 9_000, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    retrieval.write_vectors(rows, str(tmp_path / "v"))
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "v").glob("*.parquet")]
    assert len(found) == 1 and [found[0].row_group(i).num_rows for i in range(found[0].num_row_groups)] == [1, 1, 1]
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.id for r in retrieval.dense(asked, rows, k=2, stored=spark.read.parquet(str(tmp_path / "v"))).orderBy("rank").collect()] == [8_999, 8_998]


def test_heaps_of_many_tiles(spark, monkeypatch):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")).alias("embedding"))
    qs = spark.range(50).select(F.col("id").alias("query_id"), F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double")).alias("vector"))
    whole = retrieval.dense(qs, rows, k=4).collect()
    monkeypatch.setattr(vectors, "TILE", 4)
    monkeypatch.setattr(vectors, "GROUPS", 2)
    assert sorted(retrieval.dense(qs, rows, k=4).collect()) == sorted(whole)


def corpus(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string"), words


def test_block_max_equals_plain_and_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FIRST_PARTS", 3)
    docs, words = corpus(spark)
    rare = sorted(set(words), key=lambda w: (-len(w), w))[:12]
    qs = spark.createDataFrame([(i, f"{w} w1 w2") for i, w in enumerate(rare)] + [(97, "w1"), (98, "nowhere"), (99, None)], "query_id long, query string")
    index = retrieval.index(docs)
    postings.write(index.post, index.words, index.size, str(tmp_path / "i"), part_docs=32)
    built = retrieval.read_index(spark, str(tmp_path / "i"))
    plain = sorted(retrieval.bm25(qs, docs, k=5).collect())
    assert sorted(retrieval.bm25(qs, docs, k=5, built=built).collect()) == plain and len(plain) > 50
    keep = F.col("doc_id") % 3 == 0
    assert sorted(retrieval.bm25(qs, docs, k=5, keep=keep, built=built).collect()) == sorted(retrieval.bm25(qs, docs, k=5, keep=keep).collect())
    asked = retrieval.postings(qs, "query_id", "query").select(F.col("id").alias("query_id"), "token", F.col("tf").alias("qtf"))
    weighed = retrieval.weights(asked, built, retrieval.Bm25(), True).withColumn("bucket", postings.bucket("token"))
    found = postings.search(weighed, built, 5, 1.5, 0.75)
    # every fourth part and more of the made corpus is never opened
    out, opened = found.left_out.count(), found.rest.select("query_id", "part").distinct().count()
    assert out > 200 and 4 * out > out + opened


def test_block_bounds_hold(spark, tmp_path):
    """No document of a part scores more than the part's bound, whatever the parameters."""
    docs, _ = corpus(spark, 400, 2)
    index = retrieval.index(docs)
    postings.write(index.post, index.words, index.size, str(tmp_path / "i"), part_docs=16)
    built = retrieval.read_index(spark, str(tmp_path / "i"))
    weighed = spark.createDataFrame([(1, "w1", 0.7, 20.0), (1, "w2", 1.3, 20.0), (2, "w1", -0.4, 20.0)], "query_id long, token string, weight double, avgdl double").withColumn("bucket", postings.bucket("token"))
    for k1, b in ((1.5, 0.75), (0.3, 1.0), (3.0, 0.0)):
        each = postings.bounded(weighed, built, k1, b)
        most = each.groupBy("query_id", "part").agg(F.sum("bound").alias("most"))
        assert postings.scored(each.drop("bound"), built, k1, b).join(most, ["query_id", "part"]).where("score > most + 1e-6").isEmpty()
    assert built.blocks.agg(F.max(F.size("ids"))).first()[0] < 60


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    retrieval.write_index(retrieval.index(docs), str(tmp_path / "i"))
    qs = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert retrieval.bm25(qs, docs, built=retrieval.read_index(spark, str(tmp_path / "i"))).count() == 0


def test_contained_equals_search(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, "", "né 日本語 x"]
    terms = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 5))) for _ in range(80)] + ["日本", "é", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    ts = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, x in enumerate(texts) if x for t in {t for t in terms if t} if t in x)
    for most in (1_000, 25):
        assert sorted(tuple(r) for r in matching.contained(df, ts, most).collect()) == want
    assert matching.contained(df, ts.limit(0)).count() == 0
    own = matching.places(df, ["aa", "b", "日本"], "id", "t").collect()
    assert sorted((r.id, r.term, r.at) for r in own) == sorted((i, t, m.start()) for i, x in enumerate(texts) if x for t in ("aa", "b", "日本") for m in re.finditer(t, x))


def test_a_hundred_thousand_terms(spark):
    """Terms are found in one pass, without a nested loop in the plan."""
    entries = spark.range(100_000).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.col("id").cast("int").alias("pos"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("tags"), F.array(F.concat(F.lit("term"), F.col("id"), F.lit("x"))).alias("trigger_keywords"))
    inputs = spark.range(2_000).select(F.col("id").alias("input_id"), F.concat(F.lit("say TERM"), F.col("id") * 49, F.lit("X and term7x "), F.repeat(F.lit("other words "), 40)).alias("text"))
    start = time.time()
    found = keyword.match(inputs, entries)
    rows = {(r.input_id, r.entry_id): r.score for r in found.collect()}
    assert time.time() - start < 60
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert len(rows) == 4_000 and rows[(3, "e147")] == 3 and rows[(1999, "e7")] == 3


def test_rate_limit_splits_a_hot_user(spark):
    """One user has nine events in ten; pauses of a window cut them into many stretches, and the answer is that of one walk."""
    rnd = random.Random(5)
    rows, t = [], 0.0
    for i in range(3_000):
        t += rnd.choice([1.0, 5.0, 20.0, 61.0, 300.0])
        rows.append(("hot" if i % 10 else None, t, i))
    df = spark.createDataFrame(rows, "k string, at double, o int").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.o: r.accepted for r in ratelimit.rate_limit(df, "k", "ts", "o", limit=2, seconds=60).collect()}
    want = {}
    for key in ("hot", None):
        own = [(t, o) for k, t, o in rows if k == key]
        want |= dict(zip([o for _, o in own], ratelimit.decide([t for t, _ in own], [], 2, 60)[0]))
    assert got == want and 0 < sum(got.values()) < len(got)
    plain = df.select("k", F.col("at").alias("t"), "o")
    assert ratelimit.stretches(plain, 60).where("k = 'hot'").select("stretch").distinct().count() > 500
    late = df.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))
    assert [r.accepted for r in ratelimit.rate_limit(late, "k", "ts", "o").collect()] == [False]


def test_blocks_outgrow_batches(spark):
    """Blocks are as large as they may be, however small the batches that the rows come in."""
    rows = spark.range(0, 3_000, 1, 1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit(True).alias("keep"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        sizes = [len(r.ids) for r in vectors.blocks(rows, 1_000).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sizes == [1_000, 1_000, 1_000]


@pytest.mark.parametrize("sent, held", [(30, 1 << 20), (1 << 22, 50)])
def test_dense_in_passes(spark, monkeypatch, sent, held):
    """Queries beyond a pass are asked in further passes, none of which joins blocks with tiles."""
    monkeypatch.setattr(vectors, "SENT", sent)
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4 + i % 3).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [*rows[:20], (998, None), (999, [1.0])]
    for stored in (retrieval.vector_blocks(df), retrieval.vector_rows(df)):
        found = retrieval.dense(spark.createDataFrame(asked, "query_id long, vector array<float>"), df, k=6, fetch=30, stored=stored)
        assert "Join" not in plan_of(found) and "Cartesian" not in plan_of(found) and "Union" in plan_of(found)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == nearest(rows[:20], rows, 6)


@pytest.mark.parametrize("sent, held", [(1 << 22, 1 << 20), (0, 1 << 20), (1 << 22, 0)])
def test_dense_joins_no_tiles(spark, monkeypatch, sent, held):
    """Few queries go to the tasks, and no row holds a block with a tile; more meet the blocks; the rows are the same, from blocks and from rows."""
    monkeypatch.setattr(vectors, "SENT", sent)
    monkeypatch.setattr(vectors, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4 + i % 3).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    qs = spark.createDataFrame(rows[:20], "query_id long, vector array<float>")
    found = retrieval.dense(qs, df, k=6)
    assert ("Join" in plan_of(found) or "Cartesian" in plan_of(found)) == (not sent or not held)
    by_rows = retrieval.dense(qs, df, k=6, stored=retrieval.vector_rows(df))
    assert "matrix#" not in plan_of(by_rows) or not sent or not held
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == nearest(rows[:20], rows, 6) and by_rows.exceptAll(found).isEmpty() and found.exceptAll(by_rows).isEmpty()
