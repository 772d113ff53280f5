"""Alignment of two tokenisations of one text, and how often their tokens go together in the corpus.

Both vocabularies' tokens are byte ranges of a space and the text.  The cumulative ends of the two token
runs are merged: where an end of A equals an end of B, a *group* is cut and the two tokens that end there
are *linked*.  The merge runs inside mapInPandas, a text at a time, and writes each text's links as distinct pairs
with how often each occurs; Spark then sums the pairs over the corpus, takes each B token's maximum, and
joins both back to the texts.

A pair may hold any share of all links.  The pairs that hold at least 1 in ``FREQUENT`` of them are at most
``FREQUENT`` by arithmetic, so they are sent to every task; only links of rarer pairs are shuffled.

Defined results: null and empty texts, and texts that either vocabulary does not give back byte for byte
(B reads U+2581 as a space), have no tokens: zeros, and an empty digest or no groups.  Rows repeat as they
come, null keys included, and each counts in the corpus.  Strings of special tokens are plain text.  An
empty table gives an empty table.  Texts of any length are aligned whole; ties for a B token's maximum all
count.  Only the key and the text are
read, so further columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as X
from lodestone.llm.bpe import PATTERN, codec

#: the most pairs that are sent to every task
FREQUENT = 100_000
#: texts that a worker takes at a time
BATCH = 256
#: bytes between white space that the rank encoder is trusted with; its time grows with their square
LONGEST = 1_000


def longest_run(raw: bytes) -> int:
    """Bytes of the longest run of white space or of other bytes."""
    space = X.IS_SPACE[np.frombuffer(raw, dtype=np.uint8)]
    return int(np.diff(np.flatnonzero(np.concatenate(([True], space[1:] != space[:-1], [True])))).max())


class Bytes:
    """A byte-level vocabulary.  Texts go through the rank encoder where it must give the same as the merges do.

    It joins any neighbours that spell a token, the merges only listed pairs; they differ only if the merges leave two
    tokens side by side that spell a third, and no split of a token is such a pair in a vocabulary that is let through here.
    """

    def __init__(self, path: str):
        self.codec = c = codec(path)
        self.bytes_of = c.bytes_of
        self.length = np.array(c.length, dtype=np.int64)
        listed = sorted(c.id_of.values())
        made = [i for i in listed if i in c.parts]
        whole = len([i for i in listed if len(c.bytes_of[i]) == 1]) == 256 and len(made) == len(listed) - 256 and made == sorted(made, key=c.made_at.__getitem__)
        splits = ((i, c.id_of.get(c.bytes_of[i][:k]), c.id_of.get(c.bytes_of[i][k:])) for i in made for k in range(1, c.length[i]))
        alike = whole and not any(u is not None and v is not None and c.parts[i] != (u, v) and c.compatible(u, v) for i, u, v in splits)
        c.fits.clear()
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={c.bytes_of[i]: i for i in listed}, special_tokens={}) if alike else None

    def encode(self, text: str, raw: bytes) -> np.ndarray:
        """Ids of a whole text, special strings as plain text; what the rank encoder takes long over goes through the codec."""
        if self.ranked is None or longest_run(raw) > LONGEST:
            return self.codec.encode_plain(text).astype(np.int64)
        return np.array(self.ranked.encode_ordinary(text), dtype=np.int64)


class Pieces:
    """A piece vocabulary with byte fallback."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), dtype=np.int64)


class Pair:
    """Two vocabularies, their token bytes, and the spellings of their ids in a digest."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        spelled_a, spelled_b = [str(i) for i in range(len(self.a.bytes_of))], [str(i) for i in range(len(self.b.bytes_of))]
        # an A id inside and at the end of its group, a B id inside and at the end of its group
        self.spelled = [f"{s}{end}" for names, end in ((spelled_a, ","), (spelled_a, "|"), (spelled_b, ","), (spelled_b, ";")) for s in names]
        self.first = np.cumsum([0, len(spelled_a), len(spelled_a), len(spelled_b)])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none if either does not give the text back."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not text:
            return none
        whole = f" {text}"
        raw = whole.encode()
        a, b = self.a.encode(whole, raw), self.b.encode(text)
        if any(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != raw for side, ids in ((self.a, a), (self.b, b))):
            return none
        return a, b

    def merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, place in b, byte offset) of the tokens that end together: the two pointers meet there."""
        ends_a, ends_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.searchsorted(ends_b, ends_a)
        meet = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(b) else np.empty(0, np.int64)
        return meet, at[meet], ends_a[meet]

    def spell(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.concatenate(([0], at_b + 1))
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + before_b[group_a]] = a + self.first[last_a]
        out[np.arange(len(b)) + (at_a + 1)[group_b]] = b + self.first[2 + last_b]
        return "".join(map(self.spelled.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """Read once per Python worker; the paths are ones that every executor has (an installed package's files)."""
    return Pair(path_a, path_b)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    # pandas would turn whole numbers beside nulls into floats, so keys travel as text
    return df.select(F.col(key).cast("string").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))


def groups(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, alignment: array<struct<a: array<int>, b: array<int>, end: long>>), a text's groups with their last byte offset.

    The last ids of a group's a and b are the linked tokens.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pair(path_a, path_b)

        def aligned(t: str | None) -> list[dict]:
            a, b = p.encode(t)
            at_a, at_b, ends = p.merge(a, b)
            return [{"a": x, "b": y, "end": e} for x, y, e in zip(np.split(a, at_a + 1), np.split(b, at_b + 1), ends.tolist())]

        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "alignment": [aligned(t) for t in frame["text"]]})

    found = _rows(df, key, text).mapInPandas(run, "key string, alignment array<struct<a: array<int>, b: array<int>, end: long>>")
    return found.select(F.col("key").cast(df.schema[key].dataType).alias(key), "alignment")


def linked(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a text's distinct linked pairs (A id times 2^32 plus B id)."""
    own = ["key", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pair(path_a, path_b)
        for frame in frames:
            out = []
            for of, row, t in zip(frame["key"], frame["row"], frame["text"]):
                a, b = p.encode(t)
                at_a, at_b, _ = p.merge(a, b)
                digest = hashlib.sha256(p.spell(a, b, at_a, at_b).encode()).hexdigest() if len(a) else ""
                pairs, times = np.unique(a[at_a] << 32 | b[at_b], return_counts=True)
                out.append((of, row, len(a), len(b), len(at_a), len(at_a), digest, pairs, times.astype(np.int32)))
            yield pd.DataFrame(out, columns=own)

    found = _rows(df, key, text).mapInPandas(run, "key string, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    return found.withColumn("key", F.col("key").cast(df.schema[key].dataType))


def pair_counts(each: DataFrame) -> DataFrame:
    """each (pair, n) -> (pair, count, best): best where no pair of the same B token counts more."""
    counts = each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # a row for each token of B's vocabulary at most
    most = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("most")))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def digest(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = df.sparkSession
    with X.batches_of(spark, BATCH):
        table = X.settled(linked(df, path_a, path_b, key, text), "links")
    each = table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = X.settled(pair_counts(each), "pair_counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * FREQUENT >= total
    hot, rare = F.broadcast(counts.where(frequent)), counts.where(~frequent)
    found = each.join(hot, "pair").unionByName(each.join(hot.select("pair"), "pair", "left_anti").join(rare, "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return table.drop("pairs", "times").join(sums, "row", "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
