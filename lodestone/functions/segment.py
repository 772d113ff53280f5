"""A segmenter with a dictionary, for scripts that put no spaces between words.

A text is a lattice: an edge for each dictionary word at each place, for each run of basic letters and digits, and for each single character.
The best path has the greatest sum of logarithms of frequencies, found from the end by dynamic programming; of equal paths the one whose
first differing word is longer.  What is no dictionary word counts as seen once.  Punctuation is kept as tokens, white space is not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as fx

#: words of a dictionary at most: the most frequent ones, and of equally frequent ones the first by code points
MOST_WORDS = 500_000
#: logarithms are whole numbers of this part, so that sums do not depend on their order
UNIT = 1_000_000
_PLAIN = regex.compile(r"[A-Za-z0-9]+|\s+|[^\s]")


class Segmenter:
    """Frequencies may be set after building: ``set`` changes one word's, and adds it if it is new."""

    def __init__(self, frequencies: dict[str, int]):
        self.trie: dict = {}
        self.total = 0
        self.frequency: dict[str, int] = {}
        for word, n in frequencies.items():
            self.set(word, n)

    def set(self, word: str, n: int) -> None:
        if not word or n < 1 or any(c.isspace() for c in word):
            raise ValueError(f"no dictionary word: {word!r}, {n}")
        self.total += n - self.frequency.get(word, 0)
        self.frequency[word] = n
        node = self.trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def weight(self, word: str) -> int:
        return round(UNIT * (math.log(self.frequency.get(word, 1)) - math.log(max(self.total, 1))))

    def words_at(self, text: str, at: int) -> Iterator[str]:
        node = self.trie
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            if "" in node:
                yield node[""]

    def cut(self, text: str) -> list[str]:
        """The words of the best path."""
        n = len(text)
        runs = {m.start(): m.end() for m in _PLAIN.finditer(text)}
        best: list[tuple[int, int]] = [(0, n)] * (n + 1)
        for at in range(n - 1, -1, -1):
            ends = {at + 1, runs.get(at, at + 1), *(at + len(w) for w in self.words_at(text, at))}
            best[at] = max((self.weight(text[at:end]) + best[end][0], end) for end in ends)
        out, at = [], 0
        while at < n:
            end = best[at][1]
            if not text[at:end].isspace():
                out.append(text[at:end])
            at = end
        return out


def dictionary(docs: DataFrame, text: str = "text", shortest: int = 2, longest: int = 12, least: int = 2, most: int = MOST_WORDS) -> DataFrame:
    """(word, n): how often the tokens of these lengths occur, if often enough; at most ``most``."""
    words = docs.select(F.explode(fx.tokens(F.col(text))).alias("word")).where(F.length("word").between(shortest, longest))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def segmenter(found: DataFrame) -> Callable[[str], list[str]]:
    """A function of a text to be given as ``segment`` to the index and the searches; found (word, n) is a dictionary, bounded by its making."""
    words = {r.word: r.n for r in found.collect()}
    sent = found.sparkSession.sparkContext.broadcast(words)
    built: list[Segmenter] = []

    def segment(text: str) -> list[str]:
        # built once in a task, from what was sent
        if not built:
            built.append(Segmenter(sent.value))
        return built[0].cut(text)

    return segment


def tokens(texts: DataFrame, segment: Callable[[str], list[str]], key: str, text: str) -> DataFrame:
    """(key, pos, token); null and empty texts have none."""
    schema = T.StructType([texts.schema[key], T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [segment(t) if t else [] for t in batch.column("t").to_pylist()]
            of = pa.array([i for i, ts in enumerate(cut) for _ in ts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(of), pa.array([p for ts in cut for p in range(len(ts))], pa.int32()), pa.array([t for ts in cut for t in ts], pa.string())], schema.names)

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
