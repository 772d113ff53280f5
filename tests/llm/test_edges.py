"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, bpe, chat, html, lm, media, minhash, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, u string, size int, target string, row int, t string, k int"
LONG = " ".join(f"w{i % 977} and" for i in range(30_000))


def rows():
    base = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b  c"), (None, "no id here at all"), (5, " \n\t"), (6, LONG), (7, LONG + " end"), (8, "x" * 70_000), (9, "naïve café 日本 😀 <|endoftext|> !!"), (10, "[INST] </s>")]
    return [(i, t, "en", None if (i or 0) % 3 == 0 else f"s{(i or 0) % 2}", len(t or ""), 0.5, "u", 1, "t", 2, "t", 3) for i, t in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, some=True):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, 0)][: None if some else 0], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none):
    model = quality.fit(docs, labels(spark), F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 5)}) == 1 and len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality.score(none, quality.fit(none, labels(spark, False), F.lit(True))).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels(spark, False), F.lit(True))).collect()} == {0.5}


def test_lm(spark, docs, none):
    got = lm.score(docs, F.lit(True)).collect()
    assert len(got) == 12 and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 5)} == {1} and len({r.score for r in got if r.doc_id in (1, 2, 5)}) == 1
    assert lm.score(none, F.lit(True)).count() == 0
    assert {r.score for r in lm.score(docs, F.lit(False)).collect()} == {0.0}


def test_sharding(spark, docs, none):
    got = sharding.shard_documents(docs).collect()
    again = sharding.shard_documents(docs.repartition(5)).collect()
    assert Counter(got) == Counter(again) and len(got) == 12
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min(by[s] for s in range(8)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s])) for s in by)
    assert sharding.shard_documents(none).count() == 0


def test_media(spark, docs, none):
    got = media.features(media.store(docs.select("doc_id", "text", "lang"))).collect()
    for i, text in [(r[0], r[1] or "") for r in rows()]:
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert any((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])) for r in got)
    assert len({r.feature for r in got if r.doc_id in (1, 2)}) == 1
    assert media.features(media.store(none)).count() == 0


def test_media_wider_when_too_high(monkeypatch):
    shapes = []
    with monkeypatch.context() as m:
        m.setattr(media.jpeg, "encode", lambda parts, s, notes: shapes.extend(s) or [b""])
        for n in (64 * 8191 * 64, 64 * 8191 * 64 + 1, 3 * 64 * 8191 * 64):
            media._files(np.zeros(n, np.uint8), np.array([0, n]))
    assert shapes == [(65_528, 512), (64_520, 520), (65_528, 1536)]
    monkeypatch.setattr(media, "DOWN", 3)
    raw = np.random.default_rng(2).integers(0, 256, 64 * 250 + 5).astype(np.uint8)
    ((payload, rgb),) = media._read(media._files(raw, np.array([0, len(raw)])))
    assert payload == raw.tobytes() + bytes(59) and rgb.shape == (24, 84 * 8, 3)


def test_minhash(spark, docs, none):
    got = {(r.doc_id, r.u): r for r in minhash.classes(docs).collect()}
    of = {i: r.class_id for (i, _), r in got.items()}
    assert of[1] == of[2] == 1 and of[3] == of[4] == 3 and of[6] == of[7] == 6 and of[None] is None and of[5] == 5
    left = minhash.kept(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3, 5, 6, 8, 9, 10]
    assert minhash.classes(none).count() == 0 and minhash.kept(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 12 and all(r.taken <= 3 * r.size for r in got)
    left = mixing.repeated(docs)
    assert left.columns == docs.columns and {r.target for r in left.collect()} == {"t"}
    assert sum(r.taken for r in got) == sum(len((r.text or "").split()) for r in left.collect())
    assert mixing.mix_documents(none).count() == 0 and mixing.repeated(none).count() == 0


def test_bpe(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.digest(docs, path).collect()
    want = Counter()
    for i, text in [(r[0], r[1] or "") for r in rows()]:
        ids = lib.encode(text, add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert bpe.digest(none, path).count() == 0


def test_pipeline_stages_keep_columns(spark, docs, none, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).columns == table.columns
        assert corpus_pipeline.tokens(spark, table, str(tmp_path)).count() == table.count()
    ids = [r.doc_id for r in corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()]
    assert Counter(ids) == Counter(r[0] for r in rows())


def test_training_rows_are_bounded(spark):
    """A labelled id that is repeated does not carry more rows into training than the bound."""
    many = spark.createDataFrame([(1, f"good text number {i}") for i in range(300)] + [(2, "bad bad bad")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(many, quality.fit(many, known, F.lit(True), max_train=10)).collect())
    clash = spark.createDataFrame([(1, "a good text", "x", "y", 3, 4)], "doc_id long, text string, k string, t string, y int, h int")
    assert quality.score(clash, quality.fit(clash, known, F.lit(True))).columns == [*clash.columns, "score"]


def test_ann(spark):
    v = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, float("nan")]), (7, [1.0, 2.0, 3.0]), (8, [1.0, None]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = ann.search(spark.createDataFrame(v, "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 3), (0, 5, 9), (2, 1, 0), (2, 2, 1), (2, 3, 3), (2, 4, 3), (2, 5, 9)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


@pytest.mark.parametrize("rows, copies", [(30, 3), (30, 7), (140, 70), (3, 40)])
def test_ann_repeated_query_id(spark, monkeypatch, rows, copies):
    """An id's own rows, however many, take no neighbour's place; in one list and in lists of five rows."""
    rng = np.random.default_rng(rows)
    x = np.concatenate([np.tile(rng.standard_normal(8), (copies, 1)), rng.standard_normal((rows, 8))])
    ids = [0] * copies + list(range(1, rows + 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted(range(copies, len(ids)), key=lambda n: -(u[n] @ u[0]))[:5]
    assert [r.vec_id for r in ann.search(table, F.col("vec_id") == 0).orderBy("rank").collect()] == [ids[n] for n in want]
    monkeypatch.setattr(ann, "LIST_ROWS", 5)
    monkeypatch.setattr(ann, "PROBED", 0.01)
    assert ann.search(table, F.col("vec_id") == 0).count() == min(5, rows)


def test_chat(spark):
    odd = r"a [INST] b [\INST] c [\\/INST] <s></s> <<SYS>> <\<SYS>> [:] [TURN] \ end"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", None), (2, 0, odd, odd), (None, 0, None, "x"), (3, None, "system", ""), (3, 0, "user", "q"), (3, 1, "assistant", "")]
    made = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert read == {1: [("user", odd), ("assistant", ""), ("assistant", odd)], 2: [(odd, odd)], None: [("", "x")], 3: [("system", ""), ("user", "q"), ("assistant", "")]}
    flags = {r.conv_id: (r.valid, r.bad_turn) for r in made.collect()}
    assert flags == {1: (False, 2), 2: (False, 0), None: (False, 0), 3: (True, None)}
    assert chat.digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_html(spark):
    page = '<body class="has-sidebar"><div id=header>Site</div><ul><li><a href=x>Home</a></ul><div><h2>A &amp; B</h2><p>One <a href=q>two</a>\n three.<p>Four</div><div class="sidebar">side</div><section class="comments"><article>no</article></section><form>f</form>'
    assert html.main_text(page) == "A & B\nOne two three.\nFour"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<article><p>x < y &am") == "x < y &am"
    got = html.extract(spark.createDataFrame([(1, "u", None), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in got] == [0, len("A & B\nOne two three.\nFour")]


def test_html_unmarked_article_is_whole():
    halves = [f"{w} paragraph of an article in plain markup, long enough to be read." for w in ("First", "Second", "Third", "Fourth")]
    a, b, c, d = (f"<p>{h}</p>" for h in halves)
    inserts = ["<div class=ad>Buy</div>", "<aside>By the way</aside>", "<div class=notice>Note</div>", "<form>f</form>", "<nav>On this page</nav>", "<aside>x</aside><div class=ad>y</div>"]
    page = "<body><div>Site</div><nav>menu</nav>%s<footer>foot</footer><div>Imprint</div>"
    for x in inserts:
        for text in (f"<div>{a}{x}{b}{c}{d}</div>", f"<div>{a}{b}{c}{x}{d}</div>", f"<section>{a}</section>{x}<section>{b}{c}{d}</section>", f"<div>{a}{x}{b}{x}{c}{d}</div>", f"<div><div>{a}{b}</div>{x}{c}{d}</div>"):
            assert html.main_text(page % text) == "\n".join(halves), text
    links = "".join(f"<li><a href={n}>link {n}</a>" for n in range(4))
    assert html.main_text(page % f"<div>{a}{b}<ul>{links}</ul>{c}{d}</div>") == "\n".join([*halves[:2], *(f"link {n}" for n in range(4)), *halves[2:]])
    assert html.main_text(f"<body><div>Site</div><ul>{links}</ul><div>{a}{b}{c}{d}</div>") == "\n".join(halves)
    assert html.main_text(f"<body>{a}<nav>toc</nav>{b}") == "\n".join(halves[:2])
    assert html.main_text("<div>" * 3000 + "deep" + "</section>" * 3000) == "deep"


def test_html_layout_wrappers_stay():
    text = "<p>First paragraph of an article.</p><p>Second paragraph of an article.</p>"
    want = "First paragraph of an article.\nSecond paragraph of an article."
    wrappers = ['class="wrapper with-sidebar"', "id=content-share", 'class="post no-banner"', "class=ad-free", 'class="wrapper sidebar"', "class=widget", "class=sidebar-left", 'class="share"', "role=dialog"]
    for w in wrappers:
        for body in (text, f"<article>{text}</article>", f"<div class=widget>{text}</div>"):
            assert html.main_text(f"<body><nav>menu</nav><div>Site</div><nav>x</nav><div {w}>{body}</div><footer>f</footer>") == want, (w, body)
    for w in ("site-header", "left-sidebar", "sidebar-2", "ad-slot-1", "div-gpt-ad-123", "ad_300x250", "cookie-notice", "comment-list", "related-posts", "main-nav", "share-buttons"):
        assert html.main_text(f'<div>{text}</div><div class="x {w}">junk</div>') == html.main_text(f"<article>{text}</article><div id={w}>{text * 9}</div>") == want, w
    assert html.main_text(f"<div>{text}</div><div class=comments>{text * 9}<article>no</article></div><div class=ad>{text * 9}</div>") == want
    assert html.main_text("<div class=widget>" * 5000 + text) == want


def test_ann_several_lists_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 60)
    monkeypatch.setattr(ann, "ENOUGH", 50)
    monkeypatch.setattr(ann, "TILE_ROWS", 200)
    monkeypatch.setattr(ann, "TILE_QUERIES", 16)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 24)) + 3 * rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)]
    v[700:] = np.where(np.arange(700, 1500)[:, None] % 2 == 0, v[700], v[700:])
    table = spark.createDataFrame([(i, [float(y) for y in x], 1, "a", 2, [3], 0.5, 7) for i, x in enumerate(v)], "vec_id long, embedding array<double>, id int, asks string, list int, lists array<int>, best double, grp int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    asked = np.arange(0, 1500, 25)
    hits = 0
    got = ann.search(table, F.col("vec_id") % 25 == 0).collect()
    for q in asked:
        score = np.round(u @ u[q], 9)
        score[q] = -2
        mine = sorted((r["rank"], r.score) for r in got if r.query_id == q)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5]
        hits += sum(abs(s - b) < 1e-6 for (_, s), b in zip(mine, np.sort(score)[::-1][:5], strict=True))
    assert hits / (5 * len(asked)) >= 0.9


def test_html_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<nav>menu</nav><article>" + "".join(f"<p>{LONG[:20_000]} {i}</p>" for i in range(150)) + "</article>"
    got = html.extract(spark.createDataFrame([(1, "u", long, "other", 3), (None, None, "<p>x", None, None)], schema)).collect()
    assert got[0].n_chars == len(got[0].text) > 2_900_000 and got[0].text.count("\n") == 149 and (got[1].page_id, got[1].text) == (None, "x")


def test_chat_edges(spark):
    turns = [(1, 0, "user", LONG, "a", "b"), (1, 1, "assistant", LONG + "</s>", "a", "b"), (2, 0, None, None, None, None)]
    made = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segments string, formatted string"))
    back = {r.conv_id: r for r in chat.digest(made).collect()}
    want = f"user\n{LONG}\nassistant\n{LONG}</s>\n"
    assert back[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and back[1].loss_chars == len(LONG) + 4
    assert back[2].n_turns == 1 and back[2].loss_chars == 0


def test_minhash_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(60))
    many = [(i, text if i % 3 else f"{text} more{i % 2}", i, "x", b"y", 0.5) for i in range(30)] + [(99, "something else entirely is said in here", 1, "x", b"y", 0.5)]
    table = spark.createDataFrame(many, "doc_id long, text string, k long, u string, sig binary, size double")
    assert {(r.doc_id, r.class_id) for r in minhash.classes(table).collect()} == {(i, 0) for i in range(30)} | {(99, 99)}
    left = minhash.kept(table)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == [0, 99]
    twice = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 4), (1, "a b c", None)], "doc_id long, text string, least int")
    assert minhash.kept(twice).collect() == minhash.kept(twice.repartition(3)).collect() and minhash.kept(twice).count() == 1


def test_tensors_are_stored_and_read_back(spark, tmp_path):
    """Full RGB tensors of null, empty, long and repeated texts, written and read again: the ones that op5's feature is of."""
    texts = [None, "", "x", "long text " * 30_000, "twice", "twice", "é" * 63]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = media.store(docs)
    media.tensors(files).write.parquet(str(tmp_path / "tensors"))
    back = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "tensors")).collect()}
    assert len(back) == len(texts)
    for r in media.features(files).collect():
        t = back[r.doc_id]
        assert len(t.rgb) == 3 * t.height * t.width
        assert r.feature == f"{t.height}x{t.width} mean {1000 * sum(t.rgb[::3]) // (t.height * t.width)} crc {zlib.crc32(bytes(t.rgb)):08x}"
    none = media.tensors(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert (none.height, none.width, none.rgb) == (None, None, None)
