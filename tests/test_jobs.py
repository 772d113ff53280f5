"""The jobs over growing and changing input, run again, and after a crash between their tables."""

import json
import os
import subprocess
import sys

import pytest
from oracle import SF, same

from jobs import eval_report, ingest_stream
from jobs import queries as jobs
from lodestone.operators import chunking, embedding

ROWS = "doc_id long, text string, lang string, extra string"


def add(spark, path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def chunks_of(spark, out):
    return sorted((tuple(r) for r in ingest_stream.current(spark, out).select("article_id", "seq", "text", "volume").collect()), key=str)


def wanted(docs):
    return sorted(((None if i is None else str(i), n, t, v) for i, (text, v) in docs.items() for n, (_, _, _, t, _, _) in enumerate(chunking.chunk_article(text or ""), 1)), key=str)


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_query(spark, name):
    same(jobs.QUERIES[name](spark, SF), jobs.ORACLE_SQL[name])


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    long = "One sentence of a text that is long enough to be cut. " * 40
    add(spark, source, [(1, long, "en", "a"), (2, "Kurz.", "de", "b"), (3, None, None, "c"), (None, "Nobody's.", "en", "d"), (4, "", "en", "e"), (2, "Kurz.", "de", "again")])
    assert ingest_stream.run(spark, source, out, check) == 6
    docs = {1: (long, "en"), 2: ("Kurz.", "de"), 3: (None, None), None: ("Nobody's.", "en"), 4: ("", "en")}
    assert chunks_of(spark, out) == wanted(docs)
    # nothing new: no rows are read and nothing is written
    before = spark.read.parquet(f"{out}/articles").count()
    assert ingest_stream.run(spark, source, out, check) == 0
    assert spark.read.parquet(f"{out}/articles").count() == before == 5
    # the input grows by a new article, an unchanged one, a changed one and one that is now empty
    add(spark, source, [(5, "New.", "fr", ""), (2, "Kurz.", "de", ""), (1, "Changed. " * 100, "en", ""), (None, "", "en", "")])
    assert ingest_stream.run(spark, source, out, check) == 4
    docs |= {5: ("New.", "fr"), 1: ("Changed. " * 100, "en"), None: ("", "en")}
    assert chunks_of(spark, out) == wanted(docs)
    added = spark.read.parquet(f"{out}/articles").where("batch = 1")
    assert {r.id for r in added.collect()} == {"5", "1", None}
    # as one run over everything would have it
    once = str(tmp_path / "once")
    ingest_stream.run(spark, source, once, str(tmp_path / "check2"), ingest_stream.Config(files_per_batch=1))
    assert chunks_of(spark, once) == wanted(docs)
    embedding.check_bijection(ingest_stream.current(spark, out), ingest_stream.vectors(spark, out))


@pytest.mark.parametrize("dies_at", [4, 5, 6])
def test_ingest_goes_on_after_a_crash(spark, tmp_path, monkeypatch, dies_at):
    """The first try dies before one of the three tables of its second batch is written; the next ends as if nothing had happened."""
    source, out, check, plain = (str(tmp_path / x) for x in ("in", "out", "check", "plain"))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(source)
    whole, tables = ingest_stream._write, []

    def dying(df, path, *by):
        tables.append(path)
        if len(tables) == dies_at:
            raise RuntimeError("lost")
        whole(df, path, *by)

    monkeypatch.setattr(ingest_stream, "_write", dying)
    conf = ingest_stream.Config(files_per_batch=1)
    with pytest.raises(Exception):
        ingest_stream.run(spark, source, out, check, conf)
    assert len(tables) == dies_at
    monkeypatch.setattr(ingest_stream, "_write", whole)
    ingest_stream.run(spark, source, out, check, conf)
    ingest_stream.run(spark, source, plain, str(tmp_path / "other"), conf)
    got, want = (spark.read.schema(ingest_stream.CHUNKS).parquet(f"{x}/chunks") for x in (out, plain))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert spark.read.parquet(f"{out}/articles").count() == spark.read.parquet(source).count()
    embedding.check_bijection(got, spark.read.schema(ingest_stream.VECTORS).parquet(f"{out}/vectors"))


def test_ingest_shuffles_no_texts(spark, tmp_path, monkeypatch):
    """A large batch of new articles is cut where it is read, and reading the chunks back joins them with replaced versions only, by broadcast."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    plans, whole = [], chunking.chunk_articles

    def seen(articles, *rest, **named):
        plans.append(articles._jdf.queryExecution().optimizedPlan().toString())
        return whole(articles, *rest, **named)

    monkeypatch.setattr(chunking, "chunk_articles", seen)
    monkeypatch.setattr(ingest_stream, "SPREAD_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        add(spark, source, [(1, "One. " * 100, "en", ""), (2, "Two.", "en", ""), (None, "None.", "en", "")])
        ingest_stream.run(spark, source, out, check)
        assert "Join" not in plans[0] and "Repartition" not in plans[0]
        add(spark, source, [(1, "One. " * 100, "en", ""), (2, "Two, changed.", "en", ""), (None, "Changed.", "en", "")])
        ingest_stream.run(spark, source, out, check)
        assert "Join" in plans[1]
        read = ingest_stream.current(spark, out)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert chunks_of(spark, out) == wanted({1: ("One. " * 100, "en"), 2: ("Two, changed.", "en"), None: ("Changed.", "en")})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest_stream.run(spark, str(tmp_path / "in"), out, str(tmp_path / "check"))
    assert ingest_stream.current(spark, out).count() == 0
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    eval_report.run(spark, str(tmp_path / "d"), str(tmp_path / "b"), str(tmp_path / "eval"))
    assert {(r.retriever, r.queries, r.mrr, r.groups) for r in spark.read.schema(eval_report.REPORT).parquet(str(tmp_path / "eval/report")).collect()} == {(n, 0, 0.0, 0.0) for n in ("opening", "whole", "fused")}


def test_eval_report(spark, tmp_path):
    docs = [(1, "the quick brown fox jumps over the lazy dog", "s1"), (2, "an entirely other text about nothing", None), (3, None, "s3"), (4, "", "s4"), (5, "say the quick brown fox jumps over the lazy dog twice", "s5")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    asked = [(1, "quick brown fox jumps over", 0), (1, "a", 0), (2, "nowhere to be found", 0), (3, None, 0), (4, "", 0), (5, "entirely other text about nothing", 0)]
    spark.createDataFrame(asked, "item_id long, text string, id int").write.parquet(str(tmp_path / "b"))
    out = str(tmp_path / "out")
    for _ in range(2):
        eval_report.run(spark, str(tmp_path / "d"), str(tmp_path / "b"), out)
        report = {r.retriever: r for r in spark.read.schema(eval_report.REPORT).parquet(f"{out}/report").collect()}
        assert {(n, r.queries, r.hit_at_1, r.mrr) for n, r in report.items()} == {(n, 2, 1.0, 1.0) for n in ("opening", "whole", "fused")}
        ranks = spark.read.schema(eval_report.RANKS).parquet(f"{out}/ranks")
        assert {(r.query_id, r.first, r.top_id, r.top_source) for r in ranks.where("retriever = 'whole'").collect()} == {(1, 1, 1, "s1"), (5, 1, 2, None)}


def test_command_lines(tmp_path):
    """Both jobs as processes of their own, with their config files."""
    for args in (["jobs/ingest_stream.py", f"{SF}/documents.parquet", f"{tmp_path}/i", f"{tmp_path}/c"], ["jobs/eval_report.py", f"{SF}/documents.parquet", f"{SF}/benchmark.parquet", f"{tmp_path}/e"]):
        root = __file__.rsplit("/tests/", 1)[0]
        done = subprocess.run([sys.executable, *args], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=280)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "wr" in done.stderr and "lodestone." in done.stderr
    assert json.load(open(f"{root}/jobs/ingest_stream.json"))["key"] == "doc_id"
