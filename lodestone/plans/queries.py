"""The registered queries, each beside the SQL that gives the same rows in DuckDB.

The tables play these parts: documents are articles (lang: category, source: volume), benchmark
passages are questions, embeddings are vectors (aligned to documents by id), events are requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunking, cleaning, conversation, embedding, evaluation, keyword, retrieval
from lodestone.sources import store
from lodestone.streaming import ratelimit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(asked: str, k: int = 8) -> str:
    """CTEs that end in bm25(query_id, rank, id, score); asked: (query_id, query)."""
    return f"""
asked AS ({asked}),
toks AS (SELECT doc_id AS id, {TOKENS.format("text")} AS ts FROM documents),
size AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM toks),
post AS (SELECT id, token, CAST(count(*) AS DOUBLE) AS tf, CAST(any_value(dl) AS DOUBLE) AS dl FROM (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM toks) GROUP BY id, token),
raw AS (SELECT token, avgdl, ln(n - df + 5e-1) - ln(df + 5e-1) AS r FROM (SELECT token, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY token), size),
idf AS (SELECT token, avgdl, CASE WHEN r < 0 THEN 25e-2 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
words AS (SELECT query_id, token, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS token FROM asked) GROUP BY query_id, token),
scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))), 6) AS score FROM words JOIN idf USING (token) JOIN post USING (token) GROUP BY query_id, id),
bm25 AS (SELECT query_id, rank, id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def _dense_sql(k: int = 8, keep: str = "true", mode: str = "pre", fetch: int = 30) -> str:
    pre, post = (keep, "true") if mode == "pre" else ("true", keep)
    return f"""
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {post} AS keep,
  round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) AS score
  FROM embeddings v, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q WHERE {pre}),
fetched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM pairs) WHERE r <= {fetch} AND keep),
dense AS (SELECT query_id, rank, id, score FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fetched) WHERE rank <= {k})"""


BENCH = "SELECT item_id AS query_id, text AS query FROM benchmark"
SHORT = f"SELECT item_id AS query_id, array_to_string({TOKENS.format('text')}[1:5], ' ') AS query FROM benchmark"
OPENING = f"SELECT doc_id AS query_id, array_to_string({TOKENS.format('text')}[1:8], ' ') AS query FROM documents WHERE doc_id % 20 = 0"


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _opening(text: str, n: int):
    """A question's wording: the text's first n tokens."""
    return F.array_join(F.slice(fx.tokens(F.col(text)), 1, n), " ")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of five tokens: whole passages are found too easily to tell retrievers apart."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), _opening("text", 5).alias("query"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_bm25_sql(BENCH)} SELECT * FROM bm25")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_bench(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(f"WITH {_dense_sql()} SELECT * FROM dense")
def dense_topk(spark, sf_dir):
    return retrieval.dense(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query(f"WITH {_dense_sql(keep='v.label IN (1, 2)', mode='pre')} SELECT * FROM dense")
def filtered_pre(spark, sf_dir):
    return retrieval.dense(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), keep=F.col("label").isin(1, 2), mode="pre")


@query(f"WITH {_dense_sql(keep='v.label IN (1, 2)', mode='post')} SELECT * FROM dense")
def filtered_post(spark, sf_dir):
    return retrieval.dense(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), keep=F.col("label").isin(1, 2), mode="post")


def _fused(spark: SparkSession, sf_dir: str, pool: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = _vector_queries(spark, sf_dir)
    # documents without a vector have their sparse list only
    asked = docs.where("doc_id % 20 = 0")
    dense = retrieval.dense(vectors, table(spark, sf_dir, "embeddings"), k=30, fetch=90)
    sparse = retrieval.bm25(asked.select(F.col("doc_id").alias("query_id"), _opening("text", 8).alias("query")), docs, k=30)
    lists = dense.select("query_id", F.lit(0).alias("list_idx"), "rank", "id").unionByName(sparse.select("query_id", F.lit(1).alias("list_idx"), "rank", "id"))
    return retrieval.fuse(lists, pool)


def _fused_sql(pool: int) -> str:
    return f"""{_bm25_sql(OPENING, 30)}, {_dense_sql(30, fetch=90)},
lists AS (SELECT query_id, 0 AS list_idx, rank, id FROM dense UNION ALL SELECT query_id, 1, rank, id FROM bm25),
summed AS (SELECT query_id, id, round(sum(1e0 / (60 + rank)), 12) AS rrf, min((list_idx, rank)) AS first FROM lists GROUP BY query_id, id),
fused AS (SELECT query_id, rank, id, rrf FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id) AS INTEGER) AS rank FROM summed) WHERE rank <= {pool})"""


@query(f"WITH {_fused_sql(8)} SELECT * FROM fused")
def rrf_hybrid(spark, sf_dir):
    return _fused(spark, sf_dir, 8)


@query(f"""WITH {_fused_sql(24)}, capped AS (SELECT * FROM (SELECT f.*, source AS grp, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS place FROM fused f JOIN documents ON id = doc_id) WHERE place <= 2)
SELECT query_id, CAST(n AS INTEGER) AS rank, id, grp, rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM capped) WHERE n <= 8""")
def rrf_diverse(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    return retrieval.cap(_fused(spark, sf_dir, 24), groups, 8)


CACHE = "SELECT text AS query, unnest([0, 1]) AS pos, unnest(['? ' || text, text || ' ?']) AS rewrite FROM benchmark WHERE item_id % 2 = 0"


@query(f"""WITH cache AS ({CACHE}) SELECT item_id AS query_id, CAST(pos AS INTEGER) AS pos, rewrite FROM benchmark JOIN cache ON text = query
UNION ALL SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END, text FROM benchmark""")
def rewrite_expand(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    cache = bench.where("item_id % 2 = 0").select(F.col("text").alias("query"), F.posexplode(F.array(F.concat(F.lit("? "), "text"), F.concat("text", F.lit(" ?")))).alias("pos", "rewrite"))
    return retrieval.expand(_bench(spark, sf_dir), cache)


REWRITTEN = f"SELECT item_id * 10 + pos AS query_id, rewrite AS query FROM (SELECT item_id, pos, rewrite FROM benchmark JOIN ({CACHE}) ON text = query UNION ALL SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END, text FROM benchmark)"


@query(f"""WITH {_bm25_sql(REWRITTEN, 30)},
summed AS (SELECT query_id // 10 AS query_id, id, round(sum(1e0 / (60 + rank)), 12) AS rrf, min((query_id % 10, rank)) AS first FROM bm25 GROUP BY query_id // 10, id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id) AS rank FROM summed) WHERE rank <= 24),
capped AS (SELECT * FROM (SELECT f.*, source AS grp, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS place FROM fused f JOIN documents ON id = doc_id) WHERE place <= 2)
SELECT query_id, CAST(n AS INTEGER) AS rank, id, grp, rrf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM capped) WHERE n <= 8""")
def rewrite_retrieval(spark, sf_dir):
    """The default chain without vectors: rewrites, a search for each, fusion and the cap."""
    docs = table(spark, sf_dir, "documents")
    rewrites = rewrite_expand(spark, sf_dir).withColumn("q", F.col("query_id") * 10 + F.col("pos"))
    found = retrieval.bm25(rewrites.select(F.col("q").alias("query_id"), F.col("rewrite").alias("query")), docs, k=30)
    lists = found.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("list_idx"), "rank", "id")
    return retrieval.cap(retrieval.fuse(lists, 24), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp")), 8)


@query(f"WITH {_bm25_sql(BENCH, 16)} SELECT query_id, CAST(n AS INTEGER) AS rank, id, 1e0 / n AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC) AS n FROM bm25 WHERE rank IN (3, 1) AND query_id IN (SELECT query_id FROM bm25 GROUP BY query_id HAVING count(*) > 8))"
       " UNION ALL SELECT query_id, rank, id, NULL FROM bm25 WHERE rank <= 8 AND query_id NOT IN (SELECT query_id FROM bm25 GROUP BY query_id HAVING count(*) > 8)")
def rerank_apply(spark, sf_dir):
    ranked = retrieval.bm25(_bench(spark, sf_dir), table(spark, sf_dir, "documents"), k=16)
    answer = F.lit('```json\n[{"index": 2}, 0, {"index": 2}, 99, {"other": 1}, "x"]\n```')
    return retrieval.rerank(ranked.select("query_id", "rank", "id"), _bench(spark, sf_dir).select("query_id", answer.alias("answer")))


@query("SELECT item_id, unnest([text, 'b']) AS s FROM benchmark")
def json_tolerant(spark, sf_dir):
    said = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.array("text", F.lit("  "), F.lit(" b "))), F.lit("\n``` done"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(fx.json_strings(said)).alias("s"))


def _results(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return retrieval.bm25(_short(spark, sf_dir), table(spark, sf_dir, "documents"), k=k)


def _named(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Rankings with the documents' columns; few rows meet each text where it is read."""
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").join(retrieval.small(ranked), "id")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which passages; passages that none holds have no answer to find."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return evaluation.holders(bench, table(spark, sf_dir, "documents"))


EVAL = f"""WITH {_bm25_sql(SHORT, 10)}, cases AS (SELECT item_id, text FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))),
first AS (SELECT c.item_id, min(rank) AS first FROM cases c LEFT JOIN (SELECT query_id, rank, text AS title FROM bm25 JOIN documents ON id = doc_id) r ON r.query_id = c.item_id AND contains(r.title, c.text) GROUP BY c.item_id)"""


@query(EVAL + " SELECT count(*) AS queries, round(coalesce(avg(CASE WHEN first <= 1 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS hit_at_1, round(coalesce(avg(CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS hit_at_5, round(coalesce(avg(CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END), 0e0), 6) AS hit_at_10, round(coalesce(avg(coalesce(1e0 / first, 0e0)), 0e0), 6) AS mrr FROM first")
def eval_metrics(spark, sf_dir):
    return evaluation.metrics(evaluation.first_hits(_gold(spark, sf_dir), _results(spark, sf_dir)))


@query(f"WITH {_bm25_sql(SHORT, 10)} SELECT id, count(DISTINCT query_id) AS queries FROM bm25 WHERE rank <= 5 GROUP BY id HAVING count(DISTINCT query_id) >= 3")
def eval_attractors(spark, sf_dir):
    return evaluation.attractors(_results(spark, sf_dir))


@query(f"WITH {_bm25_sql(SHORT, 10)} SELECT round(avg(n), 6) AS mean_groups, count(*) AS queries FROM (SELECT query_id, count(DISTINCT source) AS n FROM bm25 JOIN documents ON id = doc_id GROUP BY query_id)")
def eval_diversity(spark, sf_dir):
    return evaluation.diversity(_named(spark, sf_dir, _results(spark, sf_dir)), "source")


@query(f"WITH {_bm25_sql(SHORT, 10)} SELECT item_id AS query_id, count(*) FILTER (rank <= 5 AND contains(d.text, b.text)) = 0 AS ok, arg_min(d.text, rank) FILTER (rank <= 5 AND contains(d.text, b.text)) AS offender FROM benchmark b LEFT JOIN bm25 ON query_id = item_id LEFT JOIN documents d ON id = doc_id GROUP BY item_id")
def eval_negatives(spark, sf_dir):
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array("text").alias("anti_expected"))
    return evaluation.negatives(cases, _named(spark, sf_dir, _results(spark, sf_dir)).select("query_id", "rank", F.col("text").alias("title")))


SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?][”’」』）)〕\]】]*|[^。！？.!?]+\z'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len(ss) AS INTEGER) AS n, CAST(coalesce(list_sum(list_transform(ss, lambda s: length(s))), 0) AS BIGINT) AS chars FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents)")
def sentence_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", fx.sentences(F.col("text")).alias("ss"))
    return rows.select("doc_id", F.size("ss").alias("n"), F.aggregate("ss", F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"))


@query(f"SELECT CAST(least(length(s) // 100, 9) AS INTEGER) AS bucket, count(*) AS n FROM (SELECT unnest({SENTENCES}) AS s FROM documents) GROUP BY 1")
def sentence_stats(spark, sf_dir):
    return chunking.histogram(table(spark, sf_dir, "documents").select(F.explode(fx.sentences(F.col("text"))).alias("s")).select(F.length("s").alias("char_count")))


#: sentences walked one by one: out holds what each step emits, held what the next pack begins with
PACKED = r"""WITH RECURSIVE pieces AS (SELECT doc_id, generate_subscripts(ps, 1) AS p, unnest(ps) AS raw FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '^\n+|\n+$', '', 'g'), '[^。！？.!?]*[。！？.!?][”’」』）)〕\]】]*|[^。！？.!?]+\z') AS ps FROM documents)),
placed AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS a, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM pieces),
seq AS (SELECT doc_id, {'t': t, 'l': CAST(length(t) AS BIGINT), 'a': CAST(a AS BIGINT)} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM placed WHERE t <> ''),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, any_value(total) AS total, any_value([s])[1:0] AS held, any_value([[s]])[1:0] AS out FROM seq GROUP BY doc_id
  UNION ALL SELECT doc_id, n, total,
    CASE WHEN alone THEN held WHEN list_sum(list_transform(list_append(held, s), lambda x: x.l)) >= 450 THEN list_filter(list_append(held, s), lambda x, i: coalesce(list_sum(list_transform(list_append(held, s)[i + 1:], lambda y: y.l)), 0) < 80) ELSE list_append(held, s) END,
    list_concat(early, CASE WHEN alone THEN [[s]] WHEN list_sum(list_transform(list_append(held, s), lambda x: x.l)) >= 450 THEN [list_append(held, s)] ELSE [[s]][1:0] END)
  FROM (SELECT doc_id, n, total, s, s.l > 900 AND len(held) = 0 AS alone, CASE WHEN full_ THEN [held] ELSE [held][1:0] END AS early,
      CASE WHEN full_ THEN list_filter(held, lambda x, i: coalesce(list_sum(list_transform(held[i + 1:], lambda y: y.l)), 0) < 80) ELSE held END AS held
    FROM (SELECT w.doc_id, q.n, w.total, w.held, q.s, len(w.held) > 0 AND size + q.s.l > 900 AND size >= 300 AS full_
      FROM (SELECT *, coalesce(list_sum(list_transform(held, lambda x: x.l)), 0) AS size FROM walk) w JOIN seq q ON q.doc_id = w.doc_id AND q.n = w.n + 1))),
packs AS (SELECT doc_id, n, generate_subscripts(out, 1) AS o, unnest(out) AS pack FROM walk UNION ALL SELECT doc_id, n + 1, 1, held FROM walk WHERE n = total AND len(held) > 0),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, o) AS INTEGER) AS seq, array_to_string(list_transform(pack, lambda x: x.t), '') AS text, pack[1].a AS a, pack[-1].a + pack[-1].l AS b FROM packs)"""


@query(PACKED + " SELECT article_id, seq, format('{}-{:04d}', article_id, seq) AS chunk_id, CAST(NULL AS VARCHAR) AS section_title, CAST(NULL AS VARCHAR) AS footnote_ref, false AS is_footnote, text, CAST(length(text) AS INTEGER) AS char_count, CAST(a AS INTEGER) AS char_offset_start, CAST(b AS INTEGER) AS char_offset_end FROM chunks")
def chunk_pack(spark, sf_dir):
    return chunking.chunk_articles(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(PACKED + " SELECT CAST(sum(n) AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS footnotes, count(*) AS articles, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT article_id, count(*) AS n FROM chunks GROUP BY article_id)")
def chunk_stats(spark, sf_dir):
    return chunking.stats(chunk_pack(spark, sf_dir))


STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<nav[^>]*>.*?</nav>', '', 'gs'), '<footer[^>]*>.*?</footer>', '', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"SELECT page_id, {STRIPPED} AS text FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.stripped(F.col("html")).alias("text"))


@query(f"SELECT page_id, length(text) < 200 AS short, page_id % 3 > 0 AS tables, length(text) < 500 AS small, NOT regexp_matches(text, '[。！？.!?”’」』）)〕\\]】]\\s*\\z') AS no_stop, CAST(length(text) AS DOUBLE) / CAST(strlen(html) AS DOUBLE) BETWEEN 15e-2 AND 5e-1 AS ratio_ok FROM (SELECT page_id, html, {STRIPPED} AS text FROM pages)")
def quality_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("text", cleaning.stripped(F.col("html")))
    w = cleaning.warnings(F.col("text"), F.col("text"), F.col("page_id") % 3)
    names = {"short": "text under 200 characters", "tables": "tables found", "small": "result under 500 characters", "no_stop": "ends without a full stop"}
    return rows.select("page_id", *(F.array_contains(w, n).alias(k) for k, n in names.items()), cleaning.ratio_ok(F.col("text"), F.col("html")).alias("ratio_ok"))


#: pages hold a menu, an advert, an article of headings and paragraphs (of which some open with a bold line that is never closed), and a footer
MARKDOWN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1),
  '[ \t\n\r]+', ' ', 'g'), '<p><b>([^<]*)<br>', '<p>**\1**', 'g'), '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?(p|h1)>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'), chr(10) || ' ')"""


@query(f"SELECT page_id, {MARKDOWN} AS md, 0 AS tables FROM pages")
def page_markdown(spark, sf_dir):
    return cleaning.markdown(table(spark, sf_dir, "pages"))


@query("SELECT doc_id, CASE WHEN length(y) > 2000 THEN regexp_replace(substr(y, 1, length(y) - 6), '\\s+\\z', '') ELSE y END AS body FROM (SELECT doc_id, regexp_replace(text || chr(10) || '返回主页 x', '^\\s+', '') AS y FROM documents)")
def boilerplate_trim(spark, sf_dir):
    """A header line and a footer line are put around every text, and trimmed again."""
    page = F.concat(F.lit("Top\n毛泽东文献 m\n"), "text", F.lit("\n返回主页 x"))
    rows = table(spark, sf_dir, "documents").select("doc_id", page.alias("page"))
    return rows.withColumn("led", cleaning.trim_leading(F.col("page"))).select("doc_id", cleaning.trim_trailing(F.col("led")).alias("body"))


@query("""SELECT doc_id, marker, CAST(length(text) + 1 + p AS INTEGER) AS at, CAST(length(page) AS INTEGER) AS body_length, decision, replace(page[greatest(length(text) + 1 + p - 30, 0) + 1:length(text) + 1 + p + length(marker) + 30], chr(10), '↵') AS context
FROM (SELECT *, text || chr(10) || '返回主页 x 上一篇' AS page FROM documents), (VALUES ('返回主页', 0, 'TRIM'), ('上一篇', 7, 'SKIP_INLINE_CONTEXT')) v(marker, p, decision) WHERE length(page) > 2000""")
def boilerplate_audit(spark, sf_dir):
    page = F.concat("text", F.lit("\n返回主页 x 上一篇"))
    return cleaning.trim_audit(table(spark, sf_dir, "documents").select("doc_id", page.alias("page")), "doc_id", "page")


ENTRIES = [("e1", 0, "THE", ["and"], ["ing ", "tion"]), ("e2", 1, "der", ["und"], ["die ", "ung"]), ("e3", 2, "que", ["les "], ["eau", "aire"]), ("e4", 3, "el ", ["ción"], ["los "])]
TERMS = " UNION ALL ".join(f"SELECT '{e}' AS entry_id, {p} AS pos, '{t}' AS raw, {n} AS points" for e, p, title, tags, kws in ENTRIES for n, ts in ((3, kws), (2, tags), (1, [title])) for t in ts)
MATCH = f"""terms AS (SELECT entry_id, pos, lower(trim(raw)) AS term, points FROM ({TERMS})),
hits AS (SELECT doc_id AS input_id, entry_id, pos, sum(points) AS score FROM documents JOIN terms ON contains(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), term) GROUP BY ALL),
matched AS (SELECT input_id, CAST(rank AS INTEGER) AS rank, entry_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY score DESC, pos) AS rank FROM hits) WHERE rank <= 3)"""


def _entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "entry_id string, pos int, title string, tags array<string>, trigger_keywords array<string>")


@query(f"WITH {MATCH} SELECT * FROM matched")
def keyword_match(spark, sf_dir):
    return keyword.match(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("input_id"), "text"), _entries(spark))


@query(f"WITH {MATCH.replace('documents JOIN', 'documents2 JOIN').replace('terms AS', 'documents2 AS (SELECT item_id AS doc_id, CASE WHEN item_id % 3 = 0 THEN 42::VARCHAR ELSE text END AS text FROM benchmark), terms AS', 1)} SELECT * FROM matched UNION ALL SELECT doc_id, p, e, 0 FROM documents2, (VALUES (1, 'e2'), (2, 'e1'), (3, 'e4')) f(p, e) WHERE doc_id NOT IN (SELECT input_id FROM matched)")
def keyword_fallback(spark, sf_dir):
    text = F.when(F.col("item_id") % 3 == 0, "42").otherwise(F.col("text"))
    inputs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("input_id"), text.alias("text"))
    return keyword.with_fallback(inputs, keyword.match(inputs, _entries(spark)), ["e2", "e1", "e4"])


@query("SELECT conv_id, arg_max(text, turn) AS latest FROM conversations WHERE role = 'user' GROUP BY conv_id")
def convo_latest_user(spark, sf_dir):
    return conversation.latest_user(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, arg_max(role, turn) = 'user' AS valid FROM conversations GROUP BY conv_id")
def convo_valid(spark, sf_dir):
    return conversation.validity(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'context' || chr(10) || chr(10) || text ELSE text END AS text FROM conversations")
def convo_prompt(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversation.prompt(turns, turns.select("conv_id").distinct().withColumn("block", F.lit("context")))


#: one question has no token and so no passage
ASKED = f"{BENCH} UNION ALL SELECT -1, '??'"


@query(f"""WITH {_bm25_sql(ASKED, 3)} SELECT query_id, '<retrieved_theory>' || chr(10) || coalesce(inside, '(无相关原文 — 如无法引用,请直接做方法分析和行动建议)') || chr(10) || '</retrieved_theory>' AS block FROM asked LEFT JOIN (
SELECT query_id, string_agg('[' || rank || '] 《' || source || '》 · (引言)' || CASE WHEN id % 2 = 0 THEN ' (注释)' ELSE '' END || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || 'source: doc/' || id || chr(10), chr(10) ORDER BY rank) AS inside FROM bm25 JOIN documents d ON id = doc_id GROUP BY query_id) USING (query_id)""")
def context_block(spark, sf_dir):
    asked = _bench(spark, sf_dir).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("??").alias("query")))
    top = _named(spark, sf_dir, retrieval.bm25(asked, table(spark, sf_dir, "documents"), k=3))
    shown = top.select("query_id", "rank", F.col("source").alias("title"), F.lit(None).cast("string").alias("section"), (F.col("id") % 2 == 0).alias("is_footnote"), "text", F.concat(F.lit("doc/"), F.col("id").cast("string")).alias("source_url"))
    return conversation.context_block(asked, shown)


@query("SELECT doc_id AS query_id, CAST(p AS INTEGER) AS pos, t AS title, p = 0 AS active FROM (SELECT doc_id, unnest([0, 1]) AS p, unnest([source, 'nowhere']) AS t FROM documents)")
def citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("title"), F.lit(1).alias("rank"))
    answers = docs.select("query_id", F.concat(F.lit("As 《"), "title", F.lit("》 and 《nowhere》 say")).alias("answer"))
    return conversation.citations(answers, docs)


@query("SELECT doc_id AS query_id, 1 AS rank, source AS title FROM documents WHERE doc_id % 2 = 0")
def cited_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("title"), F.lit(1).alias("rank"))
    answers = docs.select("query_id", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("《"), "title", F.lit("》"))).otherwise(F.lit("none")).alias("answer"))
    return conversation.cited_sources(answers, docs)


@query("""WITH RECURSIVE seq AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT user_id, event_id, n, true AS accepted, [t] AS kept FROM seq WHERE n = 1
  UNION ALL SELECT s.user_id, s.event_id, s.n, len(list_filter(w.kept, lambda k: k > s.t - 86400)) < 2,
    CASE WHEN len(list_filter(w.kept, lambda k: k > s.t - 86400)) < 2 THEN list_append(list_filter(w.kept, lambda k: k > s.t - 86400), s.t) ELSE list_filter(w.kept, lambda k: k > s.t - 86400) END
  FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.n = w.n + 1)
SELECT user_id, event_id, accepted FROM walk""")
def rate_limit(spark, sf_dir):
    return ratelimit.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limit=2, seconds=86_400)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = table(spark, sf_dir, "labels").select("doc_id", F.lit("downloaded").alias("status"))
    rows = docs.join(done, "doc_id", "left")
    null = F.lit(None)
    return rows.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("volume"), F.col("lang").alias("title"), F.col("n_chars").alias("year"), null.cast("int").alias("month"), F.col("lang").alias("category"), null.cast("string").alias("url_primary"), null.cast("string").alias("provider"), "status")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS id, source AS volume, lang AS title, n_chars AS year, CAST(NULL AS INTEGER) AS month, lang AS category, CAST(NULL AS VARCHAR) AS url_primary, CAST(NULL AS VARCHAR) AS provider, CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'downloaded' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def article_list(spark, sf_dir):
    return store.listing(_articles(spark, sf_dir))


@query("SELECT count(*) AS articles, count(l.doc_id) AS downloaded, (SELECT count(*) FROM benchmark) AS chunks FROM documents d LEFT JOIN labels l USING (doc_id)")
def health(spark, sf_dir):
    return store.health(_articles(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def crawl_worklist(spark, sf_dir):
    return store.worklist(_articles(spark, sf_dir)).select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return embedding.remaining(table(spark, sf_dir, "documents").select("doc_id"), done, "doc_id")


@query("SELECT doc_id, substr(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 1, 120) AS preview FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 5000")
def filtered_preview(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"category": F.col("lang"), "year": F.col("n_chars")})
    return rows.where(retrieval.filters(years=(500, 5000), category="en")).select("doc_id", fx.preview(F.col("text")).alias("preview"))


def _hashed_sql(name: str, texts: str) -> str:
    """CTEs that end in name(id, b, v): the components that are not zero of texts (id, text), as the stand-in for a model has them."""
    return f"""{name}_raw AS (SELECT id, h % 512 AS b, sum(CASE WHEN h // 512 % 2 = 1 THEN length(token) ELSE -length(token) END) AS v FROM (SELECT id, token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h
  FROM (SELECT DISTINCT id, unnest({TOKENS.format("text")}) AS token FROM ({texts}))) GROUP BY id, h % 512),
{name} AS (SELECT id, b, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS v FROM {name}_raw WHERE v <> 0)"""


@query(f"WITH {_hashed_sql('emb', 'SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, CAST(b AS INTEGER) AS place, CAST(v AS DOUBLE) AS value FROM emb")
def embed_components(spark, sf_dir):
    """The components that are not zero of every document's vector."""
    vectors = embedding.embed(table(spark, sf_dir, "documents"), key="doc_id")
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "v")).where("v <> 0").select("doc_id", "place", F.col("v").cast("double").alias("value"))


@query()
def embed_documents(spark, sf_dir):
    return embedding.embed(table(spark, sf_dir, "documents"), key="doc_id")


@query("SELECT event_id, CASE WHEN event_type <> '' THEN event_type ELSE 'unknown' END AS client FROM events")
def client_keys(spark, sf_dir):
    hops = F.concat(F.lit(" "), "event_type", F.lit(" , 10.0.0.1"))
    return table(spark, sf_dir, "events").select("event_id", fx.client_key(hops, F.lit(None).cast("string")).alias("client"))


@query("SELECT doc_id, source AS id, 1 AS rank, 100 AS score FROM documents WHERE source IS NOT NULL")
def model_dispatch(spark, sf_dir):
    """A model answers with an unknown entry and the document's source; the unknown one is dropped."""
    docs = table(spark, sf_dir, "documents")
    answers = docs.select(F.col("doc_id").alias("input_id"), F.array(F.lit("nowhere"), "source").alias("ids"))
    found = keyword.dispatch(answers, docs.select(F.col("source").alias("entry_id")).distinct())
    return found.select(F.col("input_id").alias("doc_id"), F.col("entry_id").alias("id"), "rank", "score")
