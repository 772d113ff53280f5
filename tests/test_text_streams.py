"""The segmenter against all ways to cut, frames cut at every byte, and passages found by rare runs."""

import itertools
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import segment, tables
from lodestone.operators import cleaning, embedding, evaluation, retrieval
from lodestone.streaming import frames

WORDS = {"ab": 8, "abc": 3, "bc": 5, "c": 2, "ca": 4, "、": 3}


def best_cut(text, words):
    """The greatest sum over all ways to cut, longer first words among equals."""
    total = sum(words.values())
    weigh = lambda w: round(segment.UNIT * (math.log(words.get(w, 1)) - math.log(total)))
    ways = []
    for cuts in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        if all(len(p) == 1 or p in words for p in parts):
            ways.append((sum(map(weigh, parts)), [len(p) for p in parts], parts))
    return max(ways)[2] if text else []


@given(st.text("abc、漢", max_size=9))
@settings(max_examples=150, deadline=None)
def test_segmenter_takes_the_best_path(text):
    # a run of basic letters is an edge of its own, so letters stand in for ideographs here
    own = str.maketrans("abc", "甲乙丙")
    words = {w.translate(own): n for w, n in WORDS.items()}
    text = text.translate(own)
    got = segment.Segmenter(words).cut(text)
    assert got == best_cut(text, words)


def test_segmenter_keeps_punctuation_and_takes_frequencies(spark):
    cut = segment.Segmenter({"矛盾": 50, "矛盾论": 1, "论": 200})
    assert cut.cut("《矛盾论》，GPT4 x。\n") == ["《", "矛盾", "论", "》", "，", "GPT4", "x", "。"]
    cut.set("矛盾论", 10_000)
    assert cut.cut("《矛盾论》") == ["《", "矛盾论", "》"]
    for word, n in (("", 1), ("a b", 1), ("a", 0)):
        with pytest.raises(ValueError):
            cut.set(word, n)
    docs = spark.createDataFrame([(1, "矛盾 矛盾 普遍"), (2, "普遍 矛盾 x"), (3, None)], "doc_id int, text string")
    found = segment.dictionary(docs)
    assert {(r.word, r.n) for r in found.collect()} == {("矛盾", 3), ("普遍", 2)}
    texts = spark.createDataFrame([(1, "普遍矛盾！"), (2, None), (3, "")], "id int, text string")
    by = segment.segmenter(found)
    assert [tuple(r) for r in segment.tokens(texts, by, "id", "text").orderBy("pos").collect()] == [(1, 0, "普遍"), (1, 1, "矛盾"), (1, 2, "！")]
    # the same segmenter serves a search
    joined = spark.createDataFrame([(1, "矛盾普遍"), (2, "普遍"), (3, "x"), (4, "y")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "论矛盾")], "query_id int, query string")
    assert [r.id for r in retrieval.bm25(asked, joined, segment=by).collect()] == [1]


EVENTS = ['{"type": "text_delta", "delta": "矛盾 né"}', "[1, 2]", '{"type": "done"}']


def sent(extra=""):
    return ("".join(f"data: {e}\n\n" for e in EVENTS[:2]) + ": comment\n\n" + f"id: 7\ndata: {EVENTS[2]}\n\n" + extra).encode()


def test_events_of_every_cut():
    """Each cut of the bytes into two reads gives the same events, cuts inside a character and inside the end mark too."""
    raw = sent("data: cut o")
    for at in range(len(raw) + 1):
        first, rest = frames.events_of(raw[:at])
        second, rest = frames.events_of(rest + raw[at:])
        assert first + second == EVENTS and rest == b"data: cut o"
        assert [json.loads(e) for e in first + second]


def test_frames_across_reads(spark, tmp_path):
    """A stream of one-byte and longer reads, in an order of their own over several batches, some twice."""
    raw = sent()
    reads = [("bytes", i, raw[i : i + 1]) for i in range(len(raw))] + [("halves", i, raw[i * 20 : i * 20 + 20]) for i in range(-(-len(raw) // 20))] + [("cut", 0, b"data: a\n\ndata: b"), ("none", 0, None)]
    late = [("halves", 1), ("bytes", 5), ("bytes", 40)]
    first = [r for r in reads if r[:2] not in late][::-1]
    source = str(tmp_path / "in")
    for n, rows in enumerate((first[::2], first[1::2] + first[:9], [r for r in reads if r[:2] in late])):
        spark.createDataFrame(rows, "conn string, seq long, piece binary").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("conn string, seq long, piece binary").option("maxFilesPerTrigger", 1).parquet(source)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frames.frames(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    got = sorted((r.conn, r.n, r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([(c, n, e) for c in ("bytes", "halves") for n, e in enumerate(EVENTS)] + [("cut", 0, "a")])


def test_rare_runs_bound_the_pairs(spark):
    """Every document holds the longest word of every passage; a passage's pairs are only the documents with its rarest run."""
    n = 400
    docs = spark.createDataFrame([(i, f"the incomprehensibilities of matter number {i} are seven and incomprehensibilities end") for i in range(n)] + [(n, None), (n + 1, "")], "id int, text string")
    asked = spark.createDataFrame([(i, f"incomprehensibilities of matter number {i} are seven and") for i in range(0, n, 10)] + [(9_999, "matter that is nowhere at all here"), (9_998, ""), (9_997, None)], "query_id int, passage string")
    hits, chosen = evaluation.seeds(asked, docs)
    pairs = hits.join(chosen, "run").groupBy("query_id").count()
    assert pairs.agg(F.max("count")).first()[0] == 1 and chosen.count() == n // 10
    assert {tuple(r) for r in evaluation.holders(asked, docs, key="id").collect()} == {(i, i) for i in range(0, n, 10)}


def test_near_words_give_near_vectors():
    a, b, c, none = embedding.hashed(["the quick brown fox jumps", "a quick brown fox jumped", "entirely different sentence here", ""])
    assert a @ b > a @ c and not none.any() and abs(float(a @ a) - 1) < 1e-6


def test_table_functions_in_sql(spark):
    """Nulls, empty and short texts have no rows; each text's rows stand beside it."""
    tables.register(spark)
    page = "x" * 2_000 + "\n返回主页 a\n返回主页"
    docs = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (4, page)], "id int, text string")
    cut = spark.sql("SELECT d.id, c.seq, c.text FROM {docs} d, LATERAL chunk_text(d.text) c WHERE d.id < 4", docs=docs)
    assert [tuple(r) for r in cut.collect()] == [(1, 1, "One.Two.")]
    found = spark.sql("SELECT d.id, a.marker, a.place, a.decision FROM {docs} d, LATERAL trim_audit(d.text) a", docs=docs)
    want = cleaning.trim_audit(docs, "id", "text").select("id", "marker", F.col("at").alias("place"), "decision")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 2
