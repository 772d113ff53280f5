"""Registered queries over the remaining surface: files, lookups, views, events, answers, sections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunking, cleaning, conversation, evaluation, keyword, rendering, retrieval
from lodestone.plans.queries import BENCH, EVAL, SHORT, _articles, _bench, _bm25_sql, _gold, _short, query, table
from lodestone.sources import store
from lodestone.sources.layout import kept


@query("SELECT source AS volume, CAST(doc_id AS VARCHAR) AS id, lang AS title FROM documents")
def manifest_flatten(spark, sf_dir):
    """Manifests of one article each, flattened."""
    one = F.struct(F.col("source").alias("volume"), F.array(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"))).alias("articles"))
    return store.articles(table(spark, sf_dir, "documents").select(F.array(one).alias("volumes")))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'downloaded' END AS status, lang, CAST(quality AS VARCHAR) AS raw_size FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_update(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("pending").alias("status"), "lang")
    changes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit("downloaded").alias("status"), F.col("quality").cast("string").alias("raw_size"))
    return store.update(rows, changes)


@query("SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'volume: ' || source || chr(10) || '---' || chr(10) AS head, text AS body FROM documents")
def article_markdown(spark, sf_dir):
    """The head written before an article, and the body read back from both."""
    head = cleaning.frontmatter(id=F.col("doc_id"), volume=F.col("source"), month=F.lit(None).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), "text")
    return rows.select("doc_id", "head", store.article_body(F.concat("head", "text")).alias("body"))


@query("SELECT CAST(item_id * 7 AS VARCHAR) AS id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN l.doc_id IS NULL THEN 'not downloaded' ELSE 'found' END AS outcome, CASE WHEN l.doc_id IS NOT NULL THEN d.lang END AS title FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 7 LEFT JOIN labels l ON l.doc_id = d.doc_id")
def article_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 7).cast("string").alias("id"))
    return store.lookup(asked, _articles(spark, sf_dir), "title")


@query(f"WITH {_bm25_sql(BENCH, 4)} SELECT query_id, string_agg('[' || (rank - 1) || '] (引言)' || CASE WHEN id % 2 = 0 THEN ' [footnote]' ELSE '' END || ': ' || substr(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 1, 300), chr(10) ORDER BY rank) AS candidates FROM bm25 JOIN documents ON id = doc_id GROUP BY query_id")
def rerank_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = retrieval.bm25(_bench(spark, sf_dir), docs, k=4).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return conversation.candidate_lines(ranked.withColumns({"section": F.lit(None).cast("string"), "is_footnote": F.col("id") % 2 == 0}))


@query(f"WITH {_bm25_sql(BENCH)} SELECT query_id, source AS title, CAST(p AS INTEGER) AS p, substr(text, 1, 200) AS text FROM (SELECT query_id, source, text, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS p FROM bm25 JOIN documents ON id = doc_id) WHERE p <= 2")
def citation_popovers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranked = retrieval.bm25(_bench(spark, sf_dir), docs).join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"), "id")
    return conversation.popovers(ranked)


@query("SELECT conv_id, turn, 0 AS seq, role, text FROM conversations")
def sse_roundtrip(spark, sf_dir):
    """Every turn as a server-sent event followed by a broken frame; read back, the broken frame is dropped."""
    rows = table(spark, sf_dir, "conversations")
    sent = rows.withColumn("frames", F.concat(conversation.sse(F.col("role"), F.col("text")), F.lit("data: {broken\n\n")))
    back = conversation.read_sse(sent, "frames", "type string, payload string", "conv_id", "turn")
    return back.select("conv_id", "turn", "seq", F.col("event.type").alias("role"), F.col("event.payload").alias("text"))


@query("""WITH convs AS (SELECT conv_id, conv_id % 5 AS m, CAST(max(turn) AS INTEGER) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS query_id, 0 AS seq, 'retrieved' AS type, CASE WHEN conv_id % 3 = 0 THEN '[]' ELSE '[{"rank":1,"id":' || conv_id || '}]' END AS payload FROM convs WHERE m <> 0
UNION ALL SELECT conv_id, CAST(turn + 1 AS INTEGER), 'text_delta', text FROM conversations WHERE conv_id % 5 <> 0 AND text <> ''
UNION ALL SELECT conv_id, CASE WHEN m = 0 THEN 0 ELSE coalesce((SELECT CAST(max(turn) + 1 AS INTEGER) FROM conversations c WHERE c.conv_id = convs.conv_id AND text <> ''), 0) + 1 END, CASE WHEN m < 2 THEN 'error' ELSE 'done' END, CASE m WHEN 0 THEN 'retrieval failed: x' WHEN 1 THEN 'generation failed: y' END FROM convs""")
def event_stream(spark, sf_dir):
    """Every fifth conversation fails at retrieval and every fifth while its answer is written; some have no passages."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("pos"), F.col("text").alias("delta"))
    m = F.col("query_id") % 5
    ends = rows.select("query_id").distinct().select("query_id", F.when(m == 0, "retrieval").when(m == 1, "generation").alias("failed"), F.when(m == 0, "retrieval failed: x").when(m == 1, "generation failed: y").alias("message"))
    chunks = ends.where("query_id % 3 <> 0").select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"))
    return conversation.events(ends, chunks, rows)


@query("SELECT doc_id, lang AS best, CAST(n_chars AS INTEGER) AS n FROM documents")
def model_answer(spark, sf_dir):
    """The JSON object inside a model's wordy answer."""
    said = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.col("lang").alias("best"), F.col("n_chars").alias("n"))), F.lit("\n``` ok"))
    return table(spark, sf_dir, "documents").select("doc_id", fx.json_object(said, "best string, n int").alias("a")).select("doc_id", "a.best", "a.n")


@query("SELECT doc_id, concat_ws(chr(10), '<h2>' || lang || '</h2>', '<p>By <strong>' || source || '</strong> &amp; <span class=\"cite\" data-title=\"' || lang || '\">《' || lang || '》</span> [7]</p>', '<blockquote>', '<p>' || n_chars || '</p>', '</blockquote>', '<ul>', '<li>a</li>', '<li>b</li>', '</ul>', '<hr>') AS html FROM documents")
def answer_html(spark, sf_dir):
    text = F.concat(F.lit("# "), "lang", F.lit("\n\nBy **"), "source", F.lit("** &\n《"), "lang", F.lit("》 \\[7]\n> "), "n_chars", F.lit("\n- a\n* b\n\n---"))
    return table(spark, sf_dir, "documents").select("doc_id", rendering.rendered(text).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN lang ELSE source END AS title FROM documents")
def result_cards(spark, sf_dir):
    """Even documents have a personal title, every third an empty one."""
    own = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 0, "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), own.alias("own_title"))
    return rows.select("doc_id", *keyword.personalised(["title"]))


@query("SELECT doc_id AS entry_id, source AS title, CAST(t.p - 1 AS INTEGER) AS place, t.w AS tag FROM (SELECT doc_id, source, unnest([{'p': i, 'w': ws[i]} FOR i IN range(1, least(len(ws), 5) + 1)]) AS t FROM (SELECT doc_id, source, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ws FROM documents))")
def browse_view(spark, sf_dir):
    """Every entry's card: its first five tags in order."""
    entries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("source").alias("title"), fx.tokens(F.col("text")).alias("tags"))
    return keyword.cards(entries).select("entry_id", "title", F.posexplode("tags").alias("place", "tag"))


@query("SELECT CAST(doc_id AS VARCHAR) AS article_id, CAST(n AS VARCHAR) AS footnote_ref, CASE n WHEN 1 THEN '\\[1] first' ELSE '\\[2] second' END AS text FROM documents, (VALUES (1), (2)) v(n)")
def footnote_split(spark, sf_dir):
    """Two footnotes are put below every text and split off again."""
    page = F.concat("text", F.lit("\n\n---\n**注释**\n\\[1] first \\[2] second"))
    chunks = chunking.chunk_articles(table(spark, sf_dir, "documents").select("doc_id", page.alias("md")), "doc_id", "md")
    return chunks.where("is_footnote").select("article_id", "footnote_ref", "text")


@query("""SELECT CAST(doc_id AS VARCHAR) AS article_id, h AS section_title FROM documents, (VALUES ('First'), ('Second part')) v(h) WHERE h = 'First' OR regexp_matches(text, '\\S')""")
def section_titles(spark, sf_dir):
    """Titles of the sections of every text between headings; a blank section is none."""
    page = F.concat(F.lit("## First\nOpening.\n### Second part \n"), "text", F.lit("\n#### Empty\n\n"))
    chunks = chunking.chunk_articles(table(spark, sf_dir, "documents").select("doc_id", page.alias("md")), "doc_id", "md")
    return chunks.select("article_id", "section_title").distinct()


def _report_sql(name: str, eval_sql: str) -> str:
    hits = ", ".join(f"round(coalesce(avg(CASE WHEN first <= {k} THEN 1e0 ELSE 0e0 END), 0e0), 6) AS hit_at_{k}" for k in (1, 5, 10))
    return f"SELECT * FROM ({eval_sql} SELECT '{name}' AS retriever, count(*) AS queries, {hits}, round(coalesce(avg(coalesce(1e0 / first, 0e0)), 0e0), 6) AS mrr FROM first)"


@query(f"{_report_sql('five tokens', EVAL)} UNION ALL {_report_sql('whole passages', EVAL.replace(SHORT, BENCH))}")
def eval_compare(spark, sf_dir):
    """BM25 asked with five tokens and with whole passages, side by side."""
    asked = {"five tokens": _short(spark, sf_dir), "whole passages": _bench(spark, sf_dir)}
    # one search serves both
    each = [df.select(F.struct(F.lit(name).alias("retriever"), "query_id").alias("query_id"), "query") for name, df in asked.items()]
    found = kept(retrieval.bm25(each[0].unionByName(each[1]), table(spark, sf_dir, "documents"), k=10).select("query_id.*", "rank", "id"), "found")
    return evaluation.report(_gold(spark, sf_dir), {name: found.where(F.col("retriever") == name) for name in asked})


@query("SELECT round(sum(n_chars * CASE lang WHEN 'en' THEN 1e0 WHEN 'fr' THEN 5e0 ELSE 0e0 END) / 1e6, 6) AS price FROM documents")
def eval_cost(spark, sf_dir):
    usage = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("kind")).agg(F.sum("n_chars").alias("tokens"))
    return evaluation.cost(usage, {"en": 1.0, "fr": 5.0})


@query("SELECT doc_id, source FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 20")
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents for a reader, the same for a seed (the limit is the feature)."""
    return store.spot_check(table(spark, sf_dir, "documents").select("doc_id", "source"), 20, seed=1, key="doc_id")
