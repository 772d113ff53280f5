"""Removal of repeated strings against a dictionary of all windows, and suffix arrays against plain sorting."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from lodestone.llm import queries, suffix


def plainly(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df, key="doc_id"):
    return {r[key]: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_all_documents(spark):
    docs = queries.X.documents(spark, SF, "doc_id", "text").collect()
    got = rows_of(queries.op11_suffix_dedup(spark, SF))
    want = dict(zip([d.doc_id for d in docs], plainly([d.text for d in docs])))
    assert got == want and sum(w[1] for w in want.values()) > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 12))
def test_suffix_array(parts, length):
    """Every window once, in the order of its first bytes; neighbours' common prefixes."""
    windows = np.array([len(p) for p in parts]) - length + 1
    ends = np.cumsum(windows + length) - 1
    starts = ends - windows - length + 1
    raw = np.frombuffer(b"\0".join([*parts, bytes(length + 16)]), dtype=np.uint8)
    array = suffix.suffix_array(raw, starts, ends, windows, length)
    strings = [raw[i : i + length].tobytes() for i in array.tolist()]
    assert sorted(array.tolist()) == [i for s, w in zip(starts, windows) for i in range(s, s + w)]
    assert strings == sorted(strings)
    shared = [next((k for k in range(length) if a[k] != b[k]), length) for a, b in zip(strings, strings[1:])]
    assert suffix.common_prefixes(raw, array, length).tolist() == [0, *shared]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=120), min_size=1, max_size=6))
def test_parts_hold_every_window_once(texts):
    raws = [t.encode() for t in texts]
    got = suffix.parts_of(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), 20, 6)
    places = [(r, a + t * n + j) for r, a, n, times in zip(*(got[k].tolist() for k in ("row", "at", "n", "times"))) for t in range(times) for j in range(n)]
    assert places == [(r, i) for r, raw in enumerate(raws) for i in range(len(raw) - 19)]
    anchors = {}
    for r, a, n, lead, anchor, times in zip(*(got[k].tolist() for k in ("row", "at", "n", "lead", "anchor", "times"))):
        for i in range(times * n):
            window = raws[r][a + i : a + i + 20]
            assert anchors.setdefault(window, (anchor, lead - i % n)) == (anchor, lead - i % n)


def passage(seed, n):
    return "".join(chr(97 + x) for x in np.random.default_rng(seed).integers(0, 26, n))


def edge_texts():
    shared, line = passage(1, 230), passage(2, 150)
    texts = ["", None, "x", shared[:199], shared, passage(3, 50) + shared + passage(4, 40), passage(5, 700) + shared[10:], shared + shared, "z" * 5000, "ab" * 900 + passage(6, 10), "ab" * 300]
    texts += ["é" * 100 + passage(7, 10), "x" + "é" * 100, passage(8, 300_000), passage(8, 300_000)[100_000:262_500] + "!", "\0" * 450, passage(9, 250), passage(9, 250), passage(9, 250)]
    # one line of 150 bytes everywhere, between other bytes each time, and some neighbours in common
    return texts + [passage(100 + i, 90) + line + passage(100 + i // 2, 90) for i in range(40)]


@pytest.mark.parametrize("many", [500, 3])
def test_edges(spark, monkeypatch, many):
    """Nulls, empty and long texts, runs of one byte and of patterns, copies; and frequent anchors split by place."""
    monkeypatch.setattr(suffix, "MANY", many)
    texts = edge_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, k1 string")
    got = suffix.digest(df, "id")
    assert got.columns == ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows_of(got, "id") == dict(enumerate(plainly(texts)))


def test_small_chunks_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 1)
    texts = edge_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(suffix.digest(df)) == dict(enumerate(plainly(texts)))
    assert suffix.digest(df.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, "q" * 300), (None, "q" * 300)], "doc_id string, text string")
    assert [(r.doc_id, r.n_removed) for r in suffix.digest(nobody).collect()] == [(None, 300), (None, 300)]
