"""The jobs as queries: each runs twice on the whole tables into one new folder, and its output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import eval_report, ingest_stream
from lodestone.plans.queries import PACKED, TOKENS, _bm25_sql
from lodestone.sources.layout import scratch


def job1_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks by a file stream; the second run finds nothing new."""
    folder = scratch(spark, "job1")
    for _ in range(2):
        ingest_stream.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return ingest_stream.current(spark, f"{folder}/out").drop("batch", "section_title", "footnote_ref")


def job2_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sparse retrievers measured on the passages that documents hold; the second run overwrites the first's tables."""
    folder = scratch(spark, "job2")
    for _ in range(2):
        eval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return eval_report.output(spark, folder)


WORDING = f"SELECT item_id * 10 + p AS query_id, CASE p WHEN 0 THEN array_to_string(ws[1:5], ' ') WHEN 1 THEN array_to_string(ws[6:10], ' ') ELSE text END AS query FROM (SELECT item_id, text, {TOKENS.format('text')} AS ws FROM benchmark), (VALUES (0), (1), (2)) v(p)"
_HITS = ", ".join(f"round(coalesce(avg(CASE WHEN first <= {k} THEN 1e0 ELSE 0e0 END), 0e0), 6) AS hit_at_{k}" for k in (1, 5, 10))

QUERIES = {f.__name__: f for f in (job1_ingest_stream, job2_eval_report)}
ORACLE_SQL = {
    "job1_ingest_stream": PACKED + " SELECT article_id, seq, format('{}-{:04d}', article_id, seq) AS chunk_id, false AS is_footnote, text, CAST(length(text) AS INTEGER) AS char_count, CAST(a AS INTEGER) AS char_offset_start, CAST(b AS INTEGER) AS char_offset_end, lang AS volume"
    " FROM chunks JOIN (SELECT CAST(doc_id AS VARCHAR) AS article_id, lang FROM documents) USING (article_id)",
    "job2_eval_report": f"""WITH {_bm25_sql(WORDING, 30)},
gold AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
summed AS (SELECT query_id // 10 AS query_id, id, round(sum(1e0 / (60 + rank)), 12) AS rrf, min((query_id % 10, rank)) AS first FROM bm25 GROUP BY query_id // 10, id),
lists AS (SELECT CASE query_id % 10 WHEN 0 THEN 'opening' ELSE 'whole' END AS retriever, query_id // 10 AS query_id, rank, id FROM bm25 WHERE query_id % 10 <> 1 AND rank <= 10
  UNION ALL SELECT 'fused', query_id, CAST(rank AS INTEGER), id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id) AS rank FROM summed) WHERE rank <= 10),
asked2 AS (SELECT DISTINCT retriever, query_id FROM gold, (VALUES ('opening'), ('whole'), ('fused')) v(retriever)),
ranks AS (SELECT a.retriever, a.query_id, min(l.rank) FILTER (g.id IS NOT NULL) AS first, min(l.id) FILTER (l.rank = 1) AS top_id, count(DISTINCT d.source) AS n, count(l.id) AS any_found
  FROM asked2 a LEFT JOIN lists l USING (retriever, query_id) LEFT JOIN gold g ON g.query_id = l.query_id AND g.id = l.id LEFT JOIN documents d ON d.doc_id = l.id GROUP BY ALL),
report AS (SELECT retriever, count(*) AS queries, {_HITS}, round(coalesce(avg(coalesce(1e0 / first, 0e0)), 0e0), 6) AS mrr, round(coalesce(avg(n) FILTER (any_found > 0), 0e0), 6) AS groups FROM ranks GROUP BY retriever)
SELECT r.retriever, query_id, first, top_id, source AS top_source, queries, hit_at_1, hit_at_5, hit_at_10, mrr, groups, 'ranks' AS part FROM ranks r JOIN report USING (retriever) LEFT JOIN documents ON doc_id = top_id
UNION ALL SELECT retriever, NULL, NULL, id, NULL, count(DISTINCT query_id), NULL, NULL, NULL, NULL, NULL, 'crowded' FROM lists WHERE rank <= 5 GROUP BY retriever, id HAVING count(DISTINCT query_id) >= 3""",
}
