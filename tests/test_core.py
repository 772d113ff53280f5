"""Unit and property tests of the core operators on small made rows."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunking, cleaning, conversation, embedding, evaluation, keyword, rendering, retrieval
from lodestone.sources import store
from lodestone.streaming import ratelimit


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


def scan(text):
    """Sentences by walking characters."""
    out, at = [], 0
    i = 0
    while i < len(text):
        if text[i] in "。！？.!?":
            i += 1
            while i < len(text) and text[i] in "”’」』）)〕]】":
                i += 1
            out.append(text[at:i])
            at = i
        else:
            i += 1
    return [s.strip() for s in [*out, text[at:]] if s.strip()]


@given(st.text(alphabet="ab。！.?”）] \n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_sentences_equal_a_scanner(text):
    assert [s for s, _ in chunking.split_sentences(text)] == scan(text)


@given(st.text(max_size=40) | st.text(alphabet=st.characters(max_codepoint=127), max_size=40) | st.text(alphabet="aZ9_ \\[]*é\x1c\x7f", max_size=20))
@settings(max_examples=300, deadline=None)
def test_segments_equal_the_pattern(text):
    """ASCII takes another way than the rest."""
    assert fx.segments(text) == fx._WORDS.findall(fx._ESCAPED.sub(r"\1", text))


def test_sentences_in_spark(spark):
    text = "一。”二！？三\n第四.)five"
    assert one(spark, fx.sentences(F.col("t")), t=text) == scan(text)


def test_packing_rules():
    s = [("x" * 100, i * 100) for i in range(5)]
    assert [len(t) for t, _, _ in chunking.pack(s)] == [500, 100]
    assert [len(t) for t, _, _ in chunking.pack(s, chunking.Sizes(drop_overlap_only=True))] == [500]
    long = [("y" * 1000, 0)]
    assert [t for t, _, _ in chunking.pack(long)] == ["y" * 1000]
    assert [len(t) for t, _, _ in chunking.pack([("a" * 310, 0), ("b" * 600, 310)])] == [310, 910, 600]


def test_articles(spark):
    md = "---\ntitle: t\n---\n---\nIntro one. Two.\n## Head A\nBody a.\n### Head B\n\n   \n#### Head C\nBody c.\n\n---\n**注释**\n\\[1] first note \\[2] second"
    got = [(t, ref, note, text) for t, ref, note, text, _, _ in chunking.chunk_article(md)]
    assert got == [(None, None, False, "Intro one.Two."), ("Head A", None, False, "Body a."), ("Head C", None, False, "Body c."), ("注释", "1", True, "\\[1] first note"), ("注释", "2", True, "\\[2] second")]
    rows = chunking.chunk_articles(spark.createDataFrame([("v1", md), ("v2", None)], "id string, md string"), "id", "md")
    assert [r.chunk_id for r in rows.collect()] == [f"v1-{n:04d}" for n in range(1, 6)]
    assert chunking.stats(rows).first().footnotes == 2


def test_markdown():
    md, tables = cleaning.to_markdown("<html><head><title>x</title></head><body><nav>n</nav><h1>T</h1><!-- c --><p>a <a href=q>b</a></p><ul><li>one<li>two</ul><div class='ad big'>ad</div><table><tr><td>c</table><script>s</script>")
    assert md.startswith("# T\n\na b\n\n- one") and tables == 1 and "ad" not in md and "nav" not in md


@pytest.mark.parametrize(
    ("html", "md"),
    [
        ("<html><head><title>x</title><body><p>hello", "hello"),
        ("<title>x</title><p>a<svg><title>t</title></svg> rest", "at rest"),
        ("<ul><li class=ad>x<li>y</ul><p>after", "- y\n\nafter"),
        ("<ol><li>a<li>b<ul><li>n</ul></ol>", "1. a\n2. b\n   - n"),
        ("<ol start=4><li>a<li>b</ol>", "4. a\n5. b"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
        ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        ("<pre>x\n  y</pre><code>z</code><img src=u alt=v title=w>", '```\nx\n  y\n```\n\n`z`![v](u "w")'),
        ("<p><b>one<br><p>Next <i>two </i>end", "**one**\n\nNext *two* end"),
        ("<div>" * 3000 + "deep", "deep"),
        ("", ""),
    ],
)
def test_markdown_of(html, md):
    assert cleaning.to_markdown(html)[0] == md


@pytest.mark.parametrize(
    ("html", "md"),
    [
        ("<h1>a = &quot</h1><p>b &quot;c&quot;", '# a = &quot\n\nb "c"'),
        ("<p>a &am &quo &copy b &quotx; &amp", "a &am &quo &copy b &quotx; &"),
        ("<p>a &ampquot; &amp;copy &copy; &#38; &lt;b&gt;", "a &quot; &copy © & <b>"),
        ("<img src='a?b=1&copy=2&quot;'>", '![](a?b=1&copy=2")'),
    ],
)
def test_cut_references_stay(html, md):
    assert cleaning.to_markdown(html)[0] == md


def test_trims(spark):
    body = "y" * 2100
    text = f"top\n毛泽东文献 line\n{body}\n  返回主页 tail"
    assert one(spark, cleaning.trim_leading(cleaning.trim_trailing(F.col("t"))), t=text) == body
    short = "x\n返回主页"
    assert one(spark, cleaning.trim_trailing(F.col("t")), t=short) == short
    inline = body + " 返回主页"
    assert one(spark, cleaning.trim_trailing(F.col("t")), t=inline) == inline
    far = "z" * 1600 + "\n返回主页" + "w" * 496
    assert len(far) > 2000 and one(spark, cleaning.trim_trailing(F.col("t")), t=far) == far
    audit = cleaning.trim_audit(spark.createDataFrame([(1, text), (2, inline), (3, far), (4, "q 返回主页" + "w" * 2600), (5, "short\n返回主页")], "id int, t string"), "id", "t")
    assert {(r.id, r.decision) for r in audit.collect()} == {(1, "TRIM"), (2, "SKIP_INLINE_CONTEXT"), (3, "SKIP_NOT_NEAR_TAIL"), (4, "SKIP_BOTH")}
    assert one(spark, cleaning.collapse_blanks(F.col("t")), t="\n a \n\n\n\nb  \n") == "a\n\nb"
    assert one(spark, cleaning.frontmatter(id=F.lit("1"), month=F.lit(None).cast("int"))) == "---\nid: 1\n---\n"


def test_leading_marker_without_line_end_gives_way(spark):
    text = "毛泽东文献\n  y 中文马克思主义文库"
    assert one(spark, cleaning.trim_leading(F.col("t")), t=text) == "y 中文马克思主义文库"


def test_rendering(spark):
    assert rendering.to_html("") == ""
    assert rendering.to_html("#### A\n##### B\n1. x\n- y") == "<h4>A</h4>\n<p>##### B</p>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>"
    assert rendering.to_html("> q\n>\n> r\n|a|b|\n|-|-|\n| 1 | **2** |\nend") == (
        "<blockquote>\n<p>q</p>\n<p>r</p>\n<table><thead><tr>\n<th>a</th>\n<th>b</th>\n</tr></thead><tbody>\n<tr>\n<td>1</td>\n<td><strong>2</strong></td>\n</tr>\n</tbody></table>\n</blockquote>\n<p>end</p>"
    )
    assert rendering.to_html("|lone|") == ""
    assert rendering.to_html("it's [t](http://u) <b>") == '<p>it&#39;s <a href="http://u" target="_blank" rel="noopener">t</a> &lt;b&gt;</p>'
    assert one(spark, rendering.rendered(F.col("t")), t="a\r\nb") == "<p>a b</p>"


def test_json(spark):
    assert one(spark, fx.json_strings(F.col("t")), t='```json\n["a", " ", "b "]\n```') == ["a", "b"]
    assert one(spark, fx.json_strings(F.col("t")), t="none") is None
    assert one(spark, fx.json_object(F.col("t"), "x int"), t='so {"x": 3} ok').x == 3
    assert one(spark, fx.unescape_markdown(F.col("t")), t=r"\[a\] \* \x") == r"[a] * \x"
    assert one(spark, fx.client_key(F.col("f"), F.col("h")), f=",1.2.3.4", h="p") == ""
    assert one(spark, fx.client_key(F.col("f"), F.col("h")), f="", h="p") == "p"


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30)), max_size=30))
@settings(max_examples=100, deadline=None)
def test_cap_window_equals_greedy_walk(rows):
    ranked = [g for g, _ in rows]
    walk, seen = [], {}
    for i, g in enumerate(ranked):
        if seen.get(g, 0) < 2 and len(walk) < 8:
            seen[g] = seen.get(g, 0) + 1
            walk.append(i)
    place = [sum(x == g for x in ranked[: i + 1]) for i, g in enumerate(ranked)]
    assert [i for i, p in enumerate(place) if p <= 2][:8] == walk


def test_fusion(spark):
    lists = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 1, 3, "c")]
    got = retrieval.fuse(spark.createDataFrame(lists, "query_id int, list_idx int, rank int, id string"), 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "b", "c"] and got[0].rrf == got[1].rrf
    turned = retrieval.fuse(spark.createDataFrame(lists[::-1], "query_id int, list_idx int, rank int, id string"), 3).orderBy("rank").collect()
    assert turned == got


def test_rewrites(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, query string")
    cache = spark.createDataFrame([("x", i, f"r{i}") for i in range(7)] + [("y", 0, "y")], "query string, pos int, rewrite string")
    got = {}
    for r in retrieval.expand(q, cache).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append(r.rewrite)
    assert got == {1: ["r0", "r1", "r2", "r3", "r4", "r5"], 2: ["y"], 3: ["z"]}


def test_rerank(spark):
    c = spark.createDataFrame([(q, r, f"d{r}") for q in (1, 2) for r in range(1, 11)] + [(3, 1, "d1")], "query_id int, rank int, id string")
    a = spark.createDataFrame([(1, 'x [{"index": 4}, 0, 4, 77, "no"] y'), (2, "nothing"), (3, "[0]")], "query_id int, answer string")
    got = {}
    for r in retrieval.rerank(c, a).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got[1] == [("d5", 1.0), ("d1", 0.5)] and [i for i, _ in got[2]] == [f"d{r}" for r in range(1, 9)] and got[3] == [("d1", None)]


def test_metrics_of_recorded_ranks(spark):
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([1, 1, 1, 2, 3, 5, 8, None, None])], "query_id int, first int")
    m = evaluation.metrics(ranks).first()
    assert (m.hit_at_1, m.hit_at_5, m.hit_at_10) == (0.333333, 0.666667, 0.777778) and m.mrr == round((3 + 1 / 2 + 1 / 3 + 1 / 5 + 1 / 8) / 9, 6)
    assert evaluation.cost(spark.createDataFrame([("in", 2_000_000), ("out", 500_000)], "kind string, tokens long"), {"in": 1.0, "out": 4.0}).first().price == 4.0


def test_keywords(spark):
    e = spark.createDataFrame([("e1", 0, "Title", ["tag"], ["key", " "]), ("e2", 1, "", ["key"], [])], "entry_id string, pos int, title string, tags array<string>, trigger_keywords array<string>")
    i = spark.createDataFrame([(1, " A KEY and a title "), (2, "zzz")], "input_id int, text string")
    got = {(r.input_id, r["rank"], r.entry_id, r.score) for r in keyword.match(i, e).collect()}
    assert got == {(1, 1, "e1", 7), (1, 2, "e2", 2), (2, 1, "e1", 3)}
    ai = keyword.dispatch(spark.createDataFrame([(1, ["e2", "nope", "e1"])], "input_id int, ids array<string>"), e).orderBy("rank").collect()
    assert [(r.entry_id, r.score) for r in ai] == [("e2", 100), ("e1", 100)]
    assert spark.createDataFrame([("", "s"), ("o", "s")], "own_x string, x string").select(*keyword.personalised(["x"])).collect() == [("s",), ("o",)]


def test_conversation(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {(r.conv_id, r.valid) for r in conversation.validity(turns).collect()} == {(1, False), (2, True)}
    frames = spark.createDataFrame([('data: {"type": "done"}\n\nnoise\n\ndata: {bad\n\n',)], "s string")
    assert [r.event.type for r in conversation.read_sse(frames, "s", "type string").collect()] == ["done"]
    titles = spark.createDataFrame([(1, 1, "T", "x" * 300), (1, 2, "T", "y"), (1, 3, "T", "z")], "query_id int, rank int, title string, text string")
    assert [(r.p, len(r.text)) for r in conversation.popovers(titles).orderBy("p").collect()] == [(1, 200), (2, 1)]
    deltas = spark.createDataFrame([(1, 0, "he"), (1, 1, "y")], "query_id int, pos int, delta string")
    ends = spark.createDataFrame([(1, None, None), (2, "retrieval", "r"), (3, "generation", "g"), (4, None, None)], "query_id int, failed string, message string")
    more = deltas.unionByName(spark.createDataFrame([(2, 0, "never"), (3, 0, "half"), (3, 1, "")], deltas.schema))
    got = conversation.events(ends, titles.select("query_id", "rank", F.col("rank").alias("id")), more).orderBy("query_id", "seq").collect()
    kinds = {q: [(r.type, r.payload) for r in got if r.query_id == q] for q in (1, 2, 3, 4)}
    assert [k for k, _ in kinds[1]] == ["retrieved", "text_delta", "text_delta", "done"] and kinds[2] == [("error", "r")]
    assert kinds[3] == [("retrieved", "[]"), ("text_delta", "half"), ("error", "g")] and [k for k, _ in kinds[4]] == ["retrieved", "done"]
    blocks = conversation.context_block(ends, titles.where("rank < 3").selectExpr("query_id", "rank", "title", "'' AS section", "rank = 2 AS is_footnote", "text || '  ' AS text", "'u' AS source_url"))
    block = {r.query_id: r.block for r in blocks.collect()}
    assert block[1] == "<retrieved_theory>\n[1] 《T》 · (引言)\n" + "x" * 300 + "\nsource: u\n\n[2] 《T》 · (引言) (注释)\ny\nsource: u\n\n</retrieved_theory>"
    assert block[4] == f"<retrieved_theory>\n{conversation.NO_PASSAGES}\n</retrieved_theory>"
    assert one(spark, fx.preview(F.col("t"), 3), t="\n a\nbc ") == "a b"


def test_embedding(spark):
    chunks = spark.createDataFrame([(i, f"text {i % 3}") for i in range(70)], "chunk_id int, text string")
    v = embedding.embed(chunks)
    embedding.check_bijection(chunks, v)
    assert v.select(F.countDistinct("embedding")).first()[0] == 3
    assert embedding.remaining(chunks, v.where("chunk_id < 60")).count() == 10
    with pytest.raises(ValueError):
        embedding.check_bijection(chunks, v.where("chunk_id < 60"))
    with pytest.raises(NotImplementedError):
        embedding.provider("voyage")
    with pytest.raises(ValueError):
        embedding.provider("x")


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"volumes": [{"volume": 1, "articles": [{"id": "a", "title": "A", "year": 1930, "status": "downloaded"}, {"id": "b", "title": "B"}]}]}')
    flat = store.articles(store.read_manifest(spark, str(tmp_path / "m.json")))
    assert {(r.id, r.status) for r in store.listing(flat).collect()} == {("a", "downloaded"), ("b", "pending")}
    changed = store.update(flat, spark.createDataFrame([("b", "failed", "late")], "id string, status string, error string"))
    assert {(r.id, r.status, r.error) for r in changed.collect()} == {("a", "downloaded", None), ("b", "failed", "late")}
    with pytest.raises(KeyError):
        store.update(flat, spark.createDataFrame([("zz", "failed")], "id string, status string"))
    store.write_json(store.nested(changed), str(tmp_path / "out"))
    assert store.articles(store.read_manifest(spark, str(tmp_path / "out"), lines=True)).count() == 2
    assert store.nested(changed, 1).count() == 2
    assert [r.id for r in store.worklist(changed, ["a", "b"]).collect()] == ["b"]
    assert store.read_rewrites(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.json").write_text('{"q": ["x", "q"]}')
    assert [(r.query, r.pos, r.rewrite) for r in store.read_rewrites(spark, str(tmp_path / "r.json")).collect()] == [("q", 0, "x"), ("q", 1, "q")]
    (tmp_path / "bad.json").write_text("{oops")
    assert store.read_rewrites(spark, str(tmp_path / "bad.json")).count() == 0
    assert one(spark, store.article_body(F.col("t")), t="---\na: b\n---\nbody") == "body"
    cache = spark.createDataFrame([("q 1", 1, "b"), ("q 1", 0, "a"), ("{", 0, "}\n{")], "query string, pos int, rewrite string")
    store.write_rewrites(cache.repartition(3), str(tmp_path / "cache"))
    assert sorted(store.read_rewrites(spark, str(tmp_path / "cache")).collect()) == sorted(cache.collect())
    assert one(spark, store.decoded(F.col("b")), b=bytearray("毛泽东".encode("gb18030"))) == "毛泽东"
    assert one(spark, store.decoded(F.col("b")), b=bytearray("ü€".encode() + b"\xc3\xbf")) in ("ü€ÿ", ("ü€".encode() + b"\xc3\xbf").decode("gb18030", "replace"))
    assert one(spark, store.decoded(F.col("b")), b=bytearray(b"a\xff")) == "a\ufffd"
    twice = spark.createDataFrame([("b", 1, "failed", "late"), ("b", 2, "downloaded", None)], "id string, at int, status string, error string")
    assert [(r.status, r.error) for r in store.update(flat, twice, order="at").where("id = 'b'").collect()] == [("downloaded", "late")]
    with pytest.raises(ValueError):
        store.update(flat, twice.drop("at"))


def test_filters_keep_null_articles(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "article_id string")
    assert {r.article_id for r in rows.where(retrieval.filters(exclude=["a"])).collect()} == {None, "b"}


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "a b"))
    one = spark.read.parquet(str(tmp_path / "a b"))
    assert store.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and store.spread(one).count() == 100
    assert store.spread(spark.range(5)).count() == 5


def test_crawl_results(spark):
    rows = spark.createDataFrame([("a", "x" * 100, "y" * 30, None, None), ("b", "x" * 100, "y" * 60, None, ["w"]), ("c", None, None, None, None), ("d", "x", "x", "late", None), ("e", "", "", None, None)], "id string, html string, clean string, error string, warnings array<string>")
    got = {r.id: r for r in store.crawl_results(rows).collect()}
    assert (got["a"].status, got["a"].ratio, got["a"].warnings) == ("downloaded", 0.3, []) and got["b"].warnings == ["w", "compression ratio 60.0% outside [15%, 50%]"]
    assert (got["c"].status, got["c"].error, got["d"].error, got["e"].status, got["e"].ratio) == ("failed", "no page", "late", "downloaded", None)


def test_holders(spark):
    docs = spark.createDataFrame([(1, "so a longword here and there"), (2, "longword"), (3, None), (4, "xa longword herey ok"), (5, "hi")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "a longword here"), (2, "hi"), (3, "none at all")], "query_id int, passage string")
    assert {tuple(r) for r in evaluation.holders(asked, docs).collect()} == {(1, 1), (1, 4), (2, 5)}


def test_spot_check_and_lookup(spark):
    rows = spark.createDataFrame([(str(i), "downloaded" if i % 2 else None, f"t{i}") for i in range(50)], "id string, status string, title string")
    picked = [r.id for r in store.spot_check(rows, 10, seed=1).collect()]
    assert len(set(picked)) == 10 and picked == [r.id for r in store.spot_check(rows.repartition(7), 10, seed=1).collect()]
    assert set(picked) != {r.id for r in store.spot_check(rows, 10, seed=2).collect()} and store.spot_check(rows.limit(3), 10).count() == 3
    asked = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "id string")
    assert {tuple(r) for r in store.lookup(asked, rows, "title").collect()} == {("1", "found", "t1"), ("2", "not downloaded", None), ("x", "unknown", None), (None, "unknown", None)}


def test_rate_limit_counts_accepted_only(spark):
    rows = [(1, float(t), i) for i, t in enumerate([0, 1, 2, 11, 11.5, 12])]
    df = spark.createDataFrame(rows, "k int, t double, o int").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.accepted for r in ratelimit.rate_limit(df, "k", "ts", "o", limit=2, seconds=10).orderBy("o").collect()]
    assert got == [True, True, False, True, True, False]


@pytest.mark.parametrize("idle", [None, 1000.0])
def test_rate_limit_stream(spark, tmp_path, idle):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for n, part in enumerate([[0, 1, 2], [11, 11.5, 12]]):
        spark.createDataFrame([(1, float(t), 10 * n + i) for i, t in enumerate(part)], "k int, t double, o int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t double, o int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    name = f"limited_{idle is None}"
    q = ratelimit.rate_limit_stream(stream, 2, 10, idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + 120
        while time.monotonic() < end and spark.table(name).count() < 6:
            time.sleep(0.5)
    finally:
        q.stop()
    assert [r.accepted for r in spark.table(name).orderBy("o").collect()] == [True, True, False, True, True, False]
