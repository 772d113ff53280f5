"""Vectors learned from the corpus: the leading right singular vectors of its tf-idf rows, by a randomised method.

A text is a row over ``columns`` hashed words: 1 + log of each word's count, times the word's idf, at length one.  Texts are cut into words
once, and their rows are kept in a table that every pass reads.  A pass multiplies them with a thin matrix Q and back (A'AQ): each task adds up its own rows' part and gives it out in blocks of
columns, and blocks are added up one at a time after a shuffle.  What the driver holds is columns x (dims + EXTRA) numbers, whatever the
corpus holds.  The random start is fixed by a seed, so a fit is the same each time but for the order of sums.

Null and empty texts are rows of zeros and get the zero vector; equal texts get equal vectors; an empty corpus gives zero vectors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as fx
from lodestone.sources.layout import kept, slices, spread

COLUMNS, DIMS = 1 << 14, 128
#: columns of Q beyond those asked for, and passes that turn it towards the leading vectors
EXTRA, ROUNDS = 16, 3
#: columns of A that are added up together
BLOCK = 1_024
#: words whose columns a task's Python keeps
WORDS = 1 << 16


class _Columns(dict):
    """word -> column, of the last words seen."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word.encode()) % self.columns
        return out


@lru_cache(maxsize=4)
def _columns(columns: int) -> _Columns:
    out = _Columns()
    out.columns = columns
    return out


def counts(text: str | None, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, weights before idf) of a text's words."""
    column = _columns(columns)
    found = Counter(map(column.__getitem__, fx.segments(text.lower()))) if text else Counter()
    return np.fromiter(found.keys(), np.int64, len(found)), 1.0 + np.log(np.fromiter(found.values(), np.float64, len(found)))


def row(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return scaled(*counts(text, len(idf)), idf)


def scaled(at: np.ndarray, weight: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weight = weight * idf[at]
    return at, weight / np.sqrt((weight * weight).sum()) if len(at) else weight


def rows(texts: DataFrame, columns: int) -> DataFrame:
    """texts (t) -> (at, weight), each text's ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "t")):
            found = [counts(t, columns) for t in part.column("t").to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(at) for at, _ in found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[0] for f in found]), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[1] for f in found])))], ["at", "weight"])

    return texts.mapInArrow(run, "at array<int>, weight array<double>")


def added(found: DataFrame, width: int, columns: int, part: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all ``rows`` of what ``part`` adds to a columns x width array of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, width))
        for batch in batches:
            ends = batch.column("at").offsets.to_numpy()
            at, weight = (batch.column(c).values.to_numpy() for c in ("at", "weight"))
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                part(total, at[a:b], weight[a:b])
        for at in range(0, columns, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], ["at", "sums"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for at, sums in zip(batch.column("at").to_pylist(), batch.column("sums").to_pylist()):
                if now is not None and at != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])
                    total = None
                now, total = at, np.frombuffer(sums) + (0.0 if total is None else total)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])

    kind = "at int, sums binary"
    parts = found.mapInArrow(run, kind).repartition("at").sortWithinPartitions("at").mapInArrow(fold, kind)
    out = np.zeros((columns, width))
    for r in parts.collect():
        block = np.frombuffer(r.sums).reshape(-1, width)
        out[r.at : r.at + len(block)] = block
    return out


@dataclass(frozen=True)
class Model:
    """idf of the columns, the columns' vectors (columns x dims), and the singular values."""

    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def embed(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """(key, embedding): vectors of length one."""
        schema = T.StructType([df.schema[key], T.StructField("embedding", T.ArrayType(T.FloatType()))])
        sent = df.sparkSession.sparkContext.broadcast((self.idf, self.vectors.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, vectors = sent.value
            for batch in (p for whole in batches for p in slices(whole, "t")):
                out = np.zeros((len(batch), vectors.shape[1]), np.float32)
                for i, t in enumerate(batch.column("t").to_pylist()):
                    at, weight = row(t, idf)
                    v = weight.astype(np.float32) @ vectors[at]
                    out[i] = v / max(float(np.linalg.norm(v)), 1e-12)
                ends = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], schema.names)

        return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, schema)


def fit(docs: DataFrame, text: str = "text", dims: int = DIMS, columns: int = COLUMNS, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Reads the texts once, and their rows once for the idf and ``rounds`` + 1 times for the vectors."""
    found = kept(rows(spread(docs.select(F.col(text).alias("t"))), columns), "words")

    def seen(total: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        total[at, 0] += 1.0
        total[0, 1] += 1.0

    figures = added(found, 2, columns, seen)
    idf = np.log((1.0 + figures[0, 1]) / (1.0 + figures[:, 0])) + 1.0
    width = min(dims + EXTRA, columns)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    for n in range(rounds + 1):
        sent = docs.sparkSession.sparkContext.broadcast((idf, q))

        def turned(total: np.ndarray, at: np.ndarray, weight: np.ndarray, sent=sent) -> None:
            idf, q = sent.value
            at, weight = scaled(at, weight, idf)
            total[at] += weight[:, None] * (weight @ q[at])

        y = added(found, width, columns, turned)
        sent.unpersist()
        if n < rounds:
            q = np.linalg.qr(y)[0]
    squares, turn = np.linalg.eigh(q.T @ y)
    first = np.argsort(-squares)[:dims]
    return Model(idf, q @ turn[:, first], np.sqrt(np.maximum(squares[first], 0.0)))
