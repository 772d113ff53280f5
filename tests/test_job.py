from pyspark.sql import functions as F

from lodestone import job
from lodestone.operators import chunking, cleaning


def test_ingest_and_resume(spark, tmp_path):
    pages = "/root/testdata/sf0.001/pages.parquet"
    out = str(tmp_path / "out")
    job.run(spark, pages, out)
    articles, chunks, vectors = (spark.read.parquet(f"{out}/{t}") for t in ("articles", "chunks", "vectors"))
    assert articles.count() == spark.read.parquet(pages).count()
    assert chunks.count() == vectors.count() > articles.count()
    page = spark.read.parquet(pages).orderBy("page_id").first()
    md = articles.where(F.col("article_id") == str(page.page_id)).first().markdown
    assert md.startswith(f"---\nid: {page.page_id}\nsource: {page.url}\n---\n") and chunking.body_of(md) == cleaning.to_markdown(page.html)[0]

    before = vectors.where("pmod(hash(chunk_id), 2) = 0").collect()
    spark.createDataFrame(before, vectors.schema).write.mode("overwrite").parquet(f"{out}/half")
    resumed = job.embed(spark, chunks, f"{out}/half")
    assert 0 < len(before) < resumed.count() == chunks.count()
    assert resumed.exceptAll(vectors).isEmpty()


def test_pages_with_one_id_or_none(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "v", "<p>b"), (None, "w", "<p>c")], "page_id long, url string, html string")
    got = job.cleaned(pages).collect()
    assert sorted((r.article_id or "", r.url, (r.markdown or "")[-1:]) for r in got) == [("", "w", "c"), ("1", "u", "a"), ("1", "v", "b")]


def test_vectors_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "PART_ROWS", 10)
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(35)], "chunk_id string, text string")
    assert job.embed(spark, chunks, str(tmp_path / "v")).count() == 35


def test_empty_and_null_pages(spark, tmp_path):
    none = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    none.write.parquet(str(tmp_path / "p"))
    job.run(spark, str(tmp_path / "p"), str(tmp_path / "out"))
    job.run(spark, str(tmp_path / "p"), str(tmp_path / "out"), frozenset({"clean", "chunk"}))
    assert spark.read.parquet(str(tmp_path / "out/vectors")).count() == 0
