"""The alignment of two vocabularies against the libraries and a plain walk over all documents."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from oracle import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plainly(texts):
    """Rows as the contract has them: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    byte_of = {chr(i) if i in printable else chr(next(others)): i for i in range(256)}
    docs, count = [], Counter()
    for t in texts:
        whole = f" {t or ''}".encode()
        ids_a, ids_b = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            docs.append(([], [], [], []))
            continue
        i = j = end_a = end_b = 0
        groups, links, in_a, in_b = [], [], [], []
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b:
                end_a += len(bytes_a[i])
                in_a.append(ids_a[i])
                i += 1
            else:
                end_b += len(bytes_b[j])
                in_b.append(ids_b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, in_a)) + "|" + ",".join(map(str, in_b)))
                links.append((in_a[-1], in_b[-1]))
                in_a, in_b = [], []
        count.update(links)
        docs.append((ids_a, ids_b, groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(x), len(y), len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, k in docs]


def rows_of(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, want in zip(docs, plainly([d.text for d in docs])):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, d.doc_id


EDGES = ["", None, " ", "  \n\n x", "a", "a", "<|endoftext|> <s>x</s> <0x41>", "x▁y", "▁", "日本語です、né\tü\r\n", "a" * 70_000, "9" * 300 + " 12'll", "\n", "x \ny \n\n", "a;\r\n  b\u3000 c\x1c d", "t\t\tx\u00a0 y", "tail  ", "\0 nul", "👍🏽 fi"]


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_edges(spark, monkeypatch, frequent):
    """Nulls, empty and long texts, repeated rows, special strings; pairs sent to all tasks or nearly all shuffled."""
    monkeypatch.setattr(align, "FREQUENT", frequent)
    df = spark.createDataFrame([(None if i < 2 else 2**60 + i, t, i) for i, t in enumerate(EDGES)], "id long, text string, row int")
    got = align.digest(df, A, B, "id")
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(rows_of(got)) == Counter(plainly(EDGES))
    assert {r.id for r in got.collect()} == {None, *(2**60 + i for i in range(2, len(EDGES)))}


def test_empty_table(spark):
    assert align.digest(spark.createDataFrame([], "doc_id string, text string"), A, B).count() == 0


def test_groups(spark):
    """The groups of a text, put together again, are both token runs; links stand at their ends."""
    df = spark.createDataFrame([(1, "Unbelievable things happened."), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r.alignment for r in align.groups(df, A, B).collect()}
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert got[2] == []
    assert sum((g.a for g in got[1]), []) == a.encode(" Unbelievable things happened.").ids and sum((g.b for g in got[1]), []) == b.encode("Unbelievable things happened.")
    assert [g.end for g in got[1]][-1] == 30 and [g.end for g in got[1]] == sorted({g.end for g in got[1]})


def test_frequent_pairs_are_few(spark):
    """The pairs that go to all tasks are a bounded number, and only others' links are shuffled by pair."""
    each = spark.range(1000).select((F.col("id") % 10).alias("pair"), F.lit(1).alias("n"))
    counts = align.pair_counts(each)
    assert counts.where(F.col("count") * 5 >= 1000).count() == 0 and counts.where(F.col("count") * 10 >= 1000).count() == 10
