"""Every operator's query against a plain version, a round trip, held-out accuracy or its SQL."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, same

import corpus_pipeline
from lodestone.llm import ann, bpe, html, jpeg, lm, minhash, mixing, quality, queries, sharding
from lodestone.llm import text as X

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = queries.op1_adaptive_scan(spark, SF).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        best = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))[:5]
        mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == ids[q]]
        assert len(mine) == 5 and all(abs(s - score[ids.tolist().index(i)]) < 1e-12 for i, s in mine)
        hits += len({ids[i] for i in best} & {i for i, _ in mine})
        total += 5
    assert hits / total >= 0.9


def test_op1_recall_over_several_lists(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert len(rows) // ann.LIST_ROWS >= 20
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in queries.op1_adaptive_scan(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    hits = sum(len(got[ids[q]] & set(ids[[i for i in np.lexsort((ids, -(x @ x[q]))) if i != q][:5]].tolist())) for q in asked)
    assert hits / (5 * len(asked)) >= 0.9


def _scanned(x, lists, share):
    """(recall of 5, share of pairs left after each block of columns in all lists but the nearest) over the nearest lists of every 50th row."""
    u, q, ids = ann.unit(x), np.arange(0, len(x), 50), np.arange(len(x))
    c = ann.centres(u, lists)
    at, order = (u @ c.T).argmax(1), np.argsort(-(u[q] @ c.T), axis=1)
    first = int(np.ceil(ann.FIRST * lists))

    def part(a, b, best):
        return ann.nearest(u[q], u, ann.rotation(x.shape[1]), (q, ids), at, [o[a:b] for o in order], best, 5)

    a, b, s, _ = part(0, first, np.full(len(q), -2.0))
    kth = np.array([np.sort(s[a == i])[-5] for i in range(len(q))])
    a2, b2, s2, left = part(first, int(share * lists), kth)
    a, b, s = np.append(a, a2), np.append(b, b2), np.append(s, s2)
    score = u[q] @ u.T
    score[np.arange(len(q)), q] = -2
    best = np.argsort(-score, axis=1)[:, :5]
    return sum(len(set(b[a == i][np.argsort(-s[a == i])[:5]]) & set(best[i])) for i in range(len(q))) / best.size, left


def test_op1_tests_drop_candidates():
    rng = np.random.default_rng(4)
    even = rng.standard_normal((20_000, 64))
    recall, left = _scanned(even, 100, 0.7)
    assert recall >= 0.9 and left[0] < 0.7 and left[1] < 0.35 and left[2] < 0.1
    clustered = rng.standard_normal((100, 64))[rng.integers(0, 100, 20_000)] + 0.4 * even
    recall, left = _scanned(clustered, 100, 0.25)
    assert recall >= 0.95 and left[0] < 0.2 and left[1] < 0.1


def test_op2_held_out(spark):
    got = {r.doc_id: r for r in queries.op2_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (crc(i, 4) == 2) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels.items() if got[i].held_out]
    assert sum(right) / len(right) >= 0.9


def test_op2_plain_learner(spark, texts):
    """Features, FTRL and scores by dictionaries, one token at a time."""
    one = lambda word: int(X.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])
    top = lambda h: h >> (64 - quality.BITS)

    def grams(text):
        hs = [one(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", text.encode())]
        out = []
        for i, h in enumerate(hs):
            again = i >= 1 and h == hs[i - 1] or i >= 2 and h == hs[i - 2]
            pair = 0x5EED if again else int(X.mix(np.array([(hs[i - 1] * 3 + h) & ((1 << 64) - 1)], np.uint64))[0])
            out += [top(h), top(pair) if i else top(h)]
        return collections.Counter(out)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    order = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        lean = abs(z[i]) - (0 if i == "bias" else 0.02)
        return -math.copysign(lean, z[i]) / ((1 + math.sqrt(n[i])) / 0.5 + 0.1) if lean > 0 else 0.0

    train = sorted((i for i in labels if crc(i, 4) != 2), key=lambda i: (order[i], str(i)))
    for _ in range(4):
        for i in train:
            g = grams(texts[i].text)
            x = {k: float(np.float32(c * (quality.SCALE / g.total()))) for k, c in g.items()} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                d = (p - labels[i]) * x[k]
                z[k] += d - (math.sqrt(n[k] + d * d) - math.sqrt(n[k])) / 0.5 * w[k]
                n[k] += d * d
    for r in queries.op2_quality(spark, SF).collect():
        g = grams(texts[r.doc_id].text)
        want = 1 / (1 + math.exp(-weight("bias") - quality.SCALE * sum(c * weight(k) for k, c in g.items()) / max(g.total(), 1)))
        assert abs(r.score - want) < 1e-4 and r.predicted == (r.score >= 0.7), r


class PlainKatz:
    """The pair model by dictionaries; nothing of the library is used."""

    def __init__(self, texts):
        self.c = collections.Counter(w for ts in texts for w in ts)
        self.pairs = collections.Counter(p for ts in texts for p in zip(["<s>", *ts[:-1]], ts))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = self.factors(self.c), self.factors(self.pairs)
        self.unknown = sum((1 - self.d1.get(k, 1)) * k for k in self.c.values()) / self.n
        self.p = {w: k * self.d1.get(k, 1) / self.n for w, k in self.c.items()}
        self.after = collections.defaultdict(dict)
        for (h, w), k in self.pairs.items():
            self.after[h][w] = k

    @staticmethod
    def factors(counts):
        seen = collections.Counter(counts.values())
        rest = 6 * seen[6] / seen[1]
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * seen[r + 1] / (r * seen[r]) - rest) / (1 - rest) if seen[r] and seen[r + 1] and rest < 1 else 1
            if 0 < x < 1:
                out[r] = x
        return out

    def prob(self, h, w):
        if h not in self.after:
            return self.p.get(w, self.unknown)
        ws = self.after[h]
        total = sum(ws.values())
        freed = sum((1 - self.d2.get(k, 1)) * k for k in ws.values()) / total
        kept = 1.0
        if not freed:
            freed, kept = 1 / (total + 1), total / (total + 1)
        if w in ws:
            return ws[w] * self.d2.get(ws[w], 1) / total * kept
        return self.p.get(w, self.unknown) * freed / (1 - sum(self.p[x] for x in ws))

    def score(self, ts):
        return sum(math.log10(self.prob(h, w)) for h, w in zip(["<s>", *ts[:-1]], ts))


def test_op3_counts_by_hand(spark, texts, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 5_000)
    toks = {i: [*WORD.findall(r.text.encode().lower()), None] for i, r in texts.items()}
    katz = PlainKatz([toks[i] for i in toks if crc(i, 7) != 2])
    for h in list(katz.after)[:20]:
        assert abs(sum(katz.prob(h, w) for w in katz.c) + katz.prob(h, "never seen") - 1) < 1e-9
    for r in queries.op3_katz_backoff(spark, SF).collect():
        ts = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 7) == 2, len(ts), sum(katz.c[w] > 0 for w in ts), katz.n)
        assert math.isclose(r.base_score, sum(math.log10((katz.c[w] + 1) / (katz.n + katz.v + 1)) for w in ts), rel_tol=1e-9)
        assert math.isclose(r.score, katz.score(ts), rel_tol=1e-9)


def test_op3_stored_model_scores_other_texts(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "BATCH_BYTES", 50_000)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 5_000)
    docs = X.documents(spark, SF, "doc_id", "text")
    path = f"file://{tmp_path}/model"
    lm.fit(docs.where(X.remainder("doc_id", 7) != 2), path)
    model = lm.Model.load(spark, path)
    toks = {i: [*WORD.findall(r.text.encode().lower()), None] for i, r in texts.items()}
    katz = PlainKatz([toks[i] for i in toks if crc(i, 7) != 2])
    # the tables hold every pair once, and are partitioned
    stored = model.pairs(spark).collect()
    assert sum(len(lm.unpacked(r.w, "u8")) for r in stored) == len(katz.pairs) and len(stored) > 8
    assert sum(int(lm.unpacked(r.c, "u8").sum()) for r in stored) == katz.n
    assert any(x.name.startswith("part=") for x in (tmp_path / "model" / "pairs").iterdir())
    new = {-1: b"", -2: b"never seen words only", -3: b"the never seen of the", **{i: texts[i].text.encode() for i in list(toks)[:40]}}
    rows = spark.createDataFrame([(i, t.decode()) for i, t in new.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_with(rows, model).collect()}
    assert got.keys() == new.keys()
    for i, t in new.items():
        ts = [*WORD.findall(t.lower()), None]
        assert got[i].held_out and got[i].n_tokens == len(ts) and got[i].n_known == sum(katz.c[w] > 0 for w in ts)
        assert math.isclose(got[i].score, katz.score(ts), rel_tol=1e-9)
    assert lm.score_with(rows.limit(0), model).count() == 0


@given(st.integers(1, 5000), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_op4_permutation(n, seed):
    p = sharding.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.row_number_of(p % np.uint64(8), p // np.uint64(8), n, 8, seed).tolist() == list(range(n))


def _spark_hash(*values):
    """Spark's xxhash64 of longs (ints are four bytes) and texts."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
    return h


def test_op4_plain_numbers(spark, texts):
    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> shift)) * factor & ((1 << 64) - 1)
        return x

    n = len(texts)
    half = ((n - 1).bit_length() + 1) // 2

    def permuted(x):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for turn in range(6):
                left, right = right, left ^ mixed(right ^ mixed(turn + 1)) & ((1 << half) - 1)
            x = left << half | right
            if x < n:
                return x

    rows = [(i, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for i, r in texts.items()]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(rows, key=lambda r: (signed(_spark_hash(*r)) % 64, r))
    want = {(r[0], r[1], r[2], permuted(k) % 8, permuted(k) // 8) for k, r in enumerate(order)}
    got = queries.op4_feistel_sharding(spark, SF).collect()
    assert {(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got} == want and len(got) == n
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


@pytest.mark.parametrize("sparse", [0.0, 0.5, 0.95, 0.995])
def test_op5_coefficients_come_back(sparse):
    rng = np.random.default_rng(1)
    sizes = [1, 3, 4, 9, 30]
    c = rng.integers(-255, 256, (sum(sizes), 64))
    c[rng.random(c.shape) < sparse] = 0
    first = np.concatenate([[0], np.cumsum(sizes)])
    files = jpeg.encode([(c, first)], [(8, 8 * n) for n in sizes])
    assert np.array_equal(jpeg.coefficients([jpeg.parse(f) for f in files])[0][0], c)


def test_op5_colour_with_small_chroma():
    y, x = np.mgrid[0:32, 0:48]
    want = np.stack([x * 5, y * 7, 255 - x * 5], axis=2).clip(0, 255).astype(float)
    r, g, b = want[..., 0], want[..., 1], want[..., 2]
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 + (b - 0.299 * r - 0.587 * g - 0.114 * b) / 1.772, 128 + (r - 0.299 * r - 0.587 * g - 0.114 * b) / 1.402]
    planes[1:] = [p.reshape(16, 2, 24, 2).mean((1, 3)) for p in planes[1:]]
    basis = jpeg._BASIS / (1 << 13)
    parts = []
    for p in planes:
        h, w = p.shape
        blocks = (p - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        z = np.rint(basis.T @ blocks @ basis).astype(int).reshape(-1, 64)[:, jpeg.ZIGZAG]
        parts.append((z, np.array([0, len(z)])))
    scans = tuple(((k,), *s[1:]) for k in range(3) for s in jpeg.SCANS)
    (file,) = jpeg.encode(parts, [(32, 48)], sampling=((2, 2), (1, 1), (1, 1)), scans=scans)
    (rgb,) = jpeg.decode([file])
    assert rgb.shape == (32, 48, 3) and np.abs(rgb - want).mean() < 6


class PlainJpeg:
    """A progressive encoder of another make: plain strings of bits, no restarts, interleaved DC scans, long end-of-band runs, own tables."""

    #: The counts by length of a common DC table, and one of all AC symbols with eight bits each
    DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    AC = ([0, 0, 0, 0, 0, 0, 0, 177, 0, 0, 0, 0, 0, 0, 0, 0], [16 * r + n for r in range(16) for n in range(11)] + [0xFB])

    def __init__(self):
        self.code = {kind: self.codes(*table) for kind, table in (("dc", self.DC), ("ac", self.AC))}
        self.run, self.kept, self.longest = 0, "", 0

    @staticmethod
    def codes(lengths, symbols):
        out, code, at = {}, 0, iter(symbols)
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                out[next(at)] = f"{code:0{n}b}"
                code += 1
            code *= 2
        return out

    @staticmethod
    def value(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def ended(self):
        if not self.run:
            return ""
        n = self.run.bit_length() - 1
        out = self.code["ac"][n * 16] + (f"{self.run - (1 << n):0{n}b}" if n else "") + self.kept
        self.longest = max(self.longest, self.run)
        self.run, self.kept = 0, ""
        return out

    def dc_first(self, blocks, low):
        out, before = "", {}
        for component, b in blocks:
            v = int(b[0]) >> low
            n, bits = self.value(v - before.get(component, 0))
            before[component] = v
            out += self.code["dc"][n] + bits
        return out

    def ac_first(self, blocks, low):
        out = ""
        for b in blocks:
            zeros = 0
            for v in (int(math.copysign(abs(int(x)) >> low, int(x))) for x in b[1:]):
                if not v:
                    zeros += 1
                    continue
                out += self.ended() + self.code["ac"][0xF0] * (zeros // 16)
                n, bits = self.value(v)
                out += self.code["ac"][zeros % 16 * 16 + n] + bits
                zeros = 0
            self.run += zeros > 0
        return out + self.ended()

    def ac_refined(self, blocks, low):
        out = ""
        for b in blocks:
            size = [abs(int(x)) >> low for x in b]
            newest = max((k for k in range(1, 64) if size[k] == 1), default=0)
            zeros, more = 0, ""
            for k in range(1, 64):
                if not size[k]:
                    zeros += 1
                    continue
                while zeros > 15 and k <= newest:
                    out += self.ended() + self.code["ac"][0xF0] + more
                    zeros, more = zeros - 16, ""
                if size[k] > 1:
                    more += str(size[k] & 1)
                    continue
                out += self.ended() + self.code["ac"][zeros * 16 + 1] + ("1" if b[k] > 0 else "0") + more
                zeros, more = 0, ""
            if zeros or more:
                self.run, self.kept = self.run + 1, self.kept + more
        return out + self.ended()

    def file(self, planes, height, width, sampling):
        """planes: of each component its blocks (rows, columns, 64) over whole MCUs."""
        seg = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
        table = lambda kind, t: bytes([kind, *t[0], *t[1]])
        n = len(planes)
        out = b"\xff\xd8" + seg(0xDB, bytes([0] + [1] * 64))
        out += seg(0xC2, bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), n]) + b"".join(bytes([k + 1, h * 16 + v, 0]) for k, (h, v) in enumerate(sampling)))
        out += seg(0xC4, table(0, self.DC) + table(0x10, self.AC))

        def scan(components, first, last, high, low, bits):
            bits += "1" * (-len(bits) % 8)
            data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
            return seg(0xDA, bytes([len(components)]) + b"".join(bytes([k + 1, 0]) for k in components) + bytes([first, last, high * 16 + low])) + data

        h_most, v_most = max(h for h, _ in sampling), max(v for _, v in sampling)
        rows, columns = planes[0].shape[0] // sampling[0][1], planes[0].shape[1] // sampling[0][0]
        mcus = [(k, planes[k][y * v + i, x * h + j]) for y in range(rows) for x in range(columns) for k, (h, v) in enumerate(sampling) for i in range(v) for j in range(h)]
        own = [p[: math.ceil(math.ceil(height * v / v_most) / 8), : math.ceil(math.ceil(width * h / h_most) / 8)].reshape(-1, 64) for p, (h, v) in zip(planes, sampling, strict=True)]
        out += scan(range(n), 0, 0, 0, 1, self.dc_first(mcus, 1))
        for k in range(n):
            out += scan([k], 1, 63, 0, 1, self.ac_first(own[k], 1))
        out += scan(range(n), 0, 0, 1, 0, "".join(str(int(b[0]) & 1) for _, b in mcus))
        for k in range(n):
            out += scan([k], 1, 63, 1, 0, self.ac_refined(own[k], 0))
        return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [((1, 1),), ((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1))])
@pytest.mark.parametrize("sparse", [0.3, 0.97, 0.9995])
def test_op5_reads_files_of_another_make(sampling, sparse):
    rng = np.random.default_rng(8)
    height, width = 75, 90
    h_most, v_most = max(h for h, _ in sampling), max(v for _, v in sampling)
    planes = []
    for h, v in sampling:
        shape = math.ceil(height / (8 * v_most)) * v, math.ceil(width / (8 * h_most)) * h
        own = math.ceil(math.ceil(height * v / v_most) / 8), math.ceil(math.ceil(width * h / h_most) / 8)
        c = rng.integers(-200, 201, (*shape, 64))
        c[rng.random(c.shape) < sparse] = 0
        # blocks outside the image have a first coefficient only
        c[own[0] :, :, 1:] = 0
        c[:, own[1] :, 1:] = 0
        planes.append(c)
    plain = PlainJpeg()
    blob = plain.file(planes, height, width, sampling)
    got = jpeg.coefficients([jpeg.parse(blob)])
    for want, (c, _) in zip(planes, got, strict=True):
        assert np.array_equal(c, want.reshape(-1, 64))
    assert sparse < 0.99 or plain.longest > 1
    (rgb,) = jpeg.decode([blob])
    assert rgb.shape[:2] == (height, width)


def test_op6_all_pairs(spark, texts):
    def bag(t):
        w = t.lower().split() if t.isascii() else "".join(ch.lower() if ch.isascii() else ch for ch in t).split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])

    bags = {i: bag(r.text) for i, r in texts.items()}
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in bags:
        for j in bags:
            if i < j and bags[i] and bags[j]:
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (bags[i].total() + bags[j].total() - both) or texts[i].text == texts[j].text:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert {r.doc_id: r.class_id for r in queries.op6_dart_minhash(spark, SF).collect()} == {i: find(i) for i in root}


def test_op6_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.random(400) * 4, rng.random(400) * 4
    element = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    s = minhash.dart_signatures(np.repeat([0, 1], 400), np.concatenate([element, element]), np.concatenate([a, b]), 2, 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_op7_targets(spark, texts):
    got = queries.op7_pareto_mixing(spark, SF).collect()
    size = {i: len(WORD.findall(r.text.encode())) for i, r in texts.items()}
    sources = collections.defaultdict(int)
    for i, r in texts.items():
        sources[r.source] += size[i]
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sources))}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sources[s], mid * weight[s]) for s in sources) < sum(sources.values()) else (low, mid)
    taken = collections.Counter()
    for r in got:
        s = texts[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sources[s] and r.taken <= 3 * r.size
        assert math.isclose(r.target, min(3 * sources[s], low * weight[s]), rel_tol=1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - min(3 * sources[s], low * weight[s])) <= mixing.LONG for s in sources)
    assert collections.Counter(got) == collections.Counter(queries.op7_pareto_mixing(spark, SF).collect())


def test_op7_plain_draw(spark, texts):
    """Rates by bisection, then every source ranked and cut in one list."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    sources = collections.defaultdict(list)
    for i, r in got.items():
        sources[texts[i].source].append((i, r["size"]))
    for ids in sources.values():
        target = got[ids[0][0]].target
        cells = collections.defaultdict(lambda: [0, 0.0])
        for _, n in ids:
            if n:
                cells[math.floor(2 * math.log2(n))][0] += n
                cells[math.floor(2 * math.log2(n))][1] += n * n / (n + 32)
        low, high = 0.0, 1e9
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(3 * n, mid * w) for n, w in cells.values()) < target else (low, mid)
        m = {i: min(3.0, low * n / (n + 32)) if n else 0.0 for i, n in ids}
        need = target - sum(math.floor(m[i]) * n for i, n in ids)
        copies = {i: math.floor(m[i]) for i, _ in ids}
        for long in (True, False):
            ranked = []
            for i, n in ids:
                p = m[i] - math.floor(m[i])
                if n and p > 1e-9 and (n >= 512) == long:
                    u = ((_spark_hash((7).to_bytes(4, "little"), i, texts[i].text.encode()) >> 12) + 0.5) * 2.0**-52
                    ranked.append(((u / (1 - u)) / (p / (1 - p)), i, n))
            part = sum((m[i] - math.floor(m[i])) * n for _, i, n in ranked) if long else need
            upto = 0
            for _, i, n in sorted(ranked):
                if part > 0 and upto + n / 2 <= part:
                    copies[i] += 1
                    upto += n
                else:
                    break
            need -= upto
        assert copies == {i: got[i].copies for i, _ in ids}


def test_op7_targets_are_reshared():
    assert mixing.targets({"a": 100, "b": 1, "c": 1, None: 50}) == pytest.approx({"a": 73, "b": 3, "c": 3, None: 73})


def test_op8_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html

    for r in queries.op8_line_blocks(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)[^>]*>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op8_line_blocks_decide_where_no_article_is_marked(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = re.sub("<(/?)article", r"<\1div", r.html)
        ends = [m.end() for m in re.finditer("</p>", plain)] or [plain.index("<footer")]
        at = ends[len(ends) // 2]
        assert html.main_text(plain) == html.main_text(plain[:at] + "<aside>By the way</aside>" + plain[at:]) == html.main_text(r.html)


PROSE = "Long prose of the article that goes on and on for quite a while, so that nobody could think it were a menu. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><p>{PROSE}</p><div class='share-price'>Price 12</div><p>{PROSE}</p></article>", [PROSE, "Price 12", PROSE]),
        (f"<article><p>{PROSE}</p><section class='social history'><p>{PROSE}</p></section></article>", [PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><p class=notice-board>On the board</p></article>", [PROSE, "On the board"]),
        (f"<div><p>{PROSE}</p><div class=ad>Buy</div><p>{PROSE}</p></div>", [PROSE, PROSE]),
        (f"<div>Welcome to the site</div><div><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p><p>The end.</p></div><p>&copy; 2024 Some company</p>", ["Head", PROSE, PROSE, "The end."]),
        (f"<p>Welcome to the site</p><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>&copy; 2024 Some company</p>", ["Head", PROSE, "Short.", PROSE]),
        (f"<article><p>{PROSE}</p><p><a title=it's href=x>link</a> mid <b>don't</b> end</p></article>", [PROSE, "link mid don't end"]),
        (f"<article><header><h1>Headline</h1></header><p>{PROSE}</p></article>", ["Headline", PROSE]),
        (f"<article>One</article><article>Two</article><div><p>{PROSE * 9}</p><p>{PROSE * 9}</p></div>", [PROSE * 9, PROSE * 9]),
        (f"<nav>m</nav><article><header class='entry-header'><h1>Head</h1></header><p>{PROSE}</p><p>{PROSE}</p></article>", ["Head", PROSE, PROSE]),
        (f"<article><div class='article-header'><h1>Head</h1><p>By X</p></div><p>{PROSE}</p><p class='post-footer-text'>Note.</p><p class='comment'>Hm.</p><p>{PROSE}</p></article>", ["Head", "By X", PROSE, "Note.", "Hm.", PROSE]),
        (f"<article><p>{PROSE}</p><p class='ad'>Buy</p><p>{PROSE}</p></article>", [PROSE, PROSE]),
        (f"<h1>Head</h1><p>By John.</p><p>{PROSE}</p><p>{PROSE}</p>", ["Head", "By John.", PROSE, PROSE]),
        (f"<article><h1>H</h1><p>{PROSE}</p></article><div class=discussion><p>A: {PROSE}</p></div>", ["H", PROSE]),
        (f"<div class=col-main><h1>H</h1><p>{PROSE}</p><p>{PROSE}</p></div><div class=col-side><p>Side text</p></div>", ["H", PROSE, PROSE]),
        (f"<article><p>{PROSE}</p><p hidden>x</p><div style='color:red; display: none'>x</div><p class=hidden-gem>shown</p><label>Mail</label><p>{PROSE}</p></article>", [PROSE, "shown", PROSE]),
        ("", [""]),
        ("<p>a</p>", ["a"]),
    ],
)
def test_op8_made_pages(page, want):
    assert html.main_text(page) == "\n".join(" ".join(w.split()) for w in want)


def test_op8_windows_decide(monkeypatch):
    page = f"<body><p>Welcome to the site</p><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>All rights reserved</p></body>"
    assert html.main_text(page).count("\n") == 2
    monkeypatch.setattr(html, "SURGE", 0)
    assert html.main_text(page).count("\n") == 4


def test_op8_threshold_by_hand():
    charge = np.array([10.0, 0, 100, 200, 50, 0, 5])
    ahead, behind = html.windows(charge)
    assert ahead.tolist() == [110, 300, 350, 250, 55, 5, 5] and behind.tolist() == [10, 10, 110, 300, 350, 250, 55]
    assert html.threshold(ahead, charge) == 250 / 4 and html.threshold(ahead * 100, charge) == html.SURGE


def test_op9_sql(spark):
    same(queries.op9_chat_format(spark, SF), queries.ORACLE_SQL["op9_chat_format"])


def test_op10_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, mine = Tokenizer.from_file(path), bpe.codec(path)
    random.seed(5)
    parts = ["a", "b", "the", "  ", "\n", "é", "<|endoftext|>", "0", "12", "!!", "ß", "'s", "日本", "\x00", "²", "_", "\t", "aaaa", "́", "😀", "-"]
    for _ in range(1500):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 30)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t).tolist() == ids and mine.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_op10_library_on_documents(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op10_bpe(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id].text, add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_pipeline(spark, texts):
    """Stage by stage: what the scores, classes and copies of the operators' own queries say."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = {r.doc_id: r.score for r in queries.op2_quality(spark, SF).collect()}
    good = corpus_pipeline.quality_filter(spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {i for i, s in score.items() if s >= 0.7}
    classes = minhash.classes(good).collect()
    one = corpus_pipeline.near_duplicates(spark, good, SF)
    kept = [r.doc_id for r in one.collect()]
    of = {r.doc_id: r.class_id for r in classes}
    assert len(kept) == len({of[i] for i in kept}) == len(set(of.values()))
    copies = {r.doc_id: r.copies for r in mixing.mix_documents(one).collect()}
    mixed = corpus_pipeline.mixture(spark, one, SF)
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in copies.items() if n})
    out = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter({i: n for i, n in copies.items() if n})
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].text.encode()).hexdigest() for r in out)
