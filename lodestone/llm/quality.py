"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Tokens are runs of letters and digits (with all bytes from 0x80 on) and runs of other marks; white
space separates.  Features are hashes of tokens, of pairs of neighbouring tokens, and one shared
feature in place of a pair whose second token repeats one of the two tokens before it (so repetition
counts whatever the word is).  A
text's value of a feature is its share of the text's n-grams times ``SCALE``; the score is the
logistic function of the sparse dot product with the weights.

The model is fitted on a bounded sample: of the labelled rows that ``train`` admits, the
``max_train`` with the smallest hash of their id, in one task that returns the weights.  Everything
else covers all rows.

Defined results: null and empty texts have no features and score the bias alone; null ids and null
labels do not train; several labels of one id count by their mean (1 from 0.5 on); without any
usable label, or with one class only, every score is the share of label 1 there (0.5 if none).
Further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import text as X

BITS = 18
SCALE = 12.0
#: features (8 bytes each) of all rows that train together; further rows do not train
MOST_FEATURES = 25_000_000

_KIND = np.where(X.IS_SPACE, 0, 2).astype(np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature index of every n-gram, first n-gram of each row plus the total)."""
    if not len(raw):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[raw]
    cut = np.ones(len(raw) + 1, dtype=bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    real = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][real], edges[1:][real]
    first = np.searchsorted(starts, offsets)
    one = X.span_hashes(raw, starts, ends)
    n, counts = len(one), np.diff(first)
    two = np.zeros(n, dtype=np.uint64)
    two[1:] = X.mix(one[:-1] * np.uint64(3) + one[1:])
    # a text of n tokens has n tokens and n - 1 pairs; its first token's pair slot repeats the token
    heads = first[:-1][counts > 0]
    again = np.zeros(n, dtype=bool)
    again[2:] = one[2:] == one[:-2]
    again[(first[:-1] + 1)[counts > 1]] = False
    again[1:] |= one[1:] == one[:-1]
    two[again] = np.uint64(0x5EED)
    both = np.empty((n, 2), dtype=np.int64)
    both[:, 0] = (one >> np.uint64(64 - bits)).astype(np.int64)
    both[:, 1] = (two >> np.uint64(64 - bits)).astype(np.int64)
    both[heads, 1] = both[heads, 0]
    return both.ravel(), first * 2


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        index, first = features(raw, offsets)
        counts = np.diff(first)
        # exact per row: sums over a row's own n-grams, so equal texts score alike wherever they stand
        dots = np.array([self.weights[index[a:b]].sum(dtype=np.float64) for a, b in zip(first[:-1], first[1:], strict=True)])
        z = self.bias + SCALE * dots / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Fits by FTRL-proximal over rows of (feature index, value, label), in the order given."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        lean = np.abs(z[i]) - np.where(i < size, l1, 0)
        return np.where(lean > 0, -np.sign(z[i]) * lean / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    for _ in range(passes):
        for index, value, label in rows:
            i, x = np.append(index.astype(np.int64), size), np.append(value.astype(np.float64), 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = 6000, max_features: int = MOST_FEATURES) -> Model:
    """Fits on at most ``max_train`` labelled rows with ``max_features`` features, those with the smallest hash of their id."""
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).where("k is not null and y is not null")
    named = named.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sample = named.where(train if not isinstance(train, str) else F.expr(train)).orderBy(F.xxhash64("k"), "k").limit(max_train)
    # max_train rows of an id and a label: small enough to send to every task
    kept = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")
    schema = "k string, h long, y int, i binary, v binary"

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "t"):
                raw, offsets = X.flat(part.column("t"))
                index, first = features(raw, offsets)
                found = [np.unique(index[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k").cast(pa.string()),
                        part.column("h"),
                        part.column("y"),
                        pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()),
                        pa.array([(c * (SCALE / max(c.sum(), 1))).astype(np.float32).tobytes() for _, c in found], pa.binary()),
                    ],
                    ["k", "h", "y", "i", "v"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        room = max_features
        for batch in batches:
            for i, v, y in zip(*(batch.column(c).to_pylist() for c in "ivy"), strict=True):
                room -= len(i) // 4
                if room >= 0 or not rows:
                    rows.append((np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y))
        ys = [y for _, _, y in rows]
        if not ys or min(ys) == max(ys):
            share = min(max(sum(ys) / len(ys), 1e-6), 1 - 1e-6) if ys else 0.5
            found = Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
        else:
            found = ftrl(rows)
        yield pa.RecordBatch.from_arrays([pa.array([found.weights.tobytes()], pa.binary()), pa.array([found.bias])], ["weights", "bias"])

    # rows, not ids, are bounded: a labelled id may be repeated; one task learns from them, and only the weights reach the driver
    rows = kept.withColumn("h", F.xxhash64("k")).select("k", "h", "y", "t").mapInArrow(sparse, schema)
    model = rows.orderBy("h", "k", "i", "v", "y").limit(max_train).mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(model.weights, np.float32), model.bias) if model else Model(np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the column of scores; every row, whole texts."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != column]
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(column, T.DoubleType())])
    # 2 ** BITS floats: a fixed size, 1 MB
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for batch in batches:
            for part in X.slices(batch, text):
                scores = local.scores(*X.flat(part.column(text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], [*keep, column])

    return docs.select(*keep).mapInArrow(run, schema)
