"""Pluggable embedders and an embedding pass that resumes where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.functions import text as fx
from lodestone.sources.layout import spread

DIMS = 512
#: words whose hashes a task's Python keeps
WORDS = 1 << 16


class _Places(dict):
    """token -> component + (its gain << 32), of the last words seen."""

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:4])
        if len(self) >= WORDS:
            self.clear()
        # a token adds its length, for longer words are rarer, with a sign
        self[token] = out = (len(token) if h // self.dims % 2 else -len(token)) << 32 | h % self.dims
        return out


@lru_cache(maxsize=4)
def _places(dims: int) -> _Places:
    out = _Places()
    out.dims = dims
    return out


def hashed(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """A deterministic stand-in for a model: distinct tokens hashed to signed components, normalised; texts near in words are near."""
    place, found, sizes = _places(dims), [], []
    for t in texts:
        said = set(fx.segments(t))
        found += [place[token] for token in said]
        sizes.append(len(said))
    codes = np.array(found, np.int64)
    at = np.repeat(np.arange(len(texts)) * dims, sizes) + (codes & 0xFFFFFFFF)
    # sums of whole numbers, so their order does not matter
    out = np.bincount(at, codes >> 32, len(texts) * dims).reshape(-1, dims)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1.0)).astype(np.float32)


PROVIDERS: dict[str, Callable[[list[str]], np.ndarray] | None] = {"local": hashed, "voyage": None, "openai": None}


def provider(name: str) -> Callable[[list[str]], np.ndarray]:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedder {name}")
    if PROVIDERS[name] is None:
        raise NotImplementedError(name)
    return PROVIDERS[name]


def embed(chunks: DataFrame, name: str = "local", key: str = "chunk_id", text: str = "text", batch: int = 32) -> DataFrame:
    """(key, embedding) in batches; one row for each row of chunks."""
    encode = provider(name)
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                v = encode([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())], [key, "embedding"])

    return spread(chunks.select(key, text)).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def remaining(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """What is still to be embedded."""
    return chunks.join(done.select(key), key, "left_anti")


def check_bijection(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> None:
    """Raises unless every row of chunks has one vector and no vector is left over."""
    n = chunks.groupBy(key).count().withColumnRenamed("count", "c").join(vectors.groupBy(key).count().withColumnRenamed("count", "v"), key, "full")
    if not n.where("c is null or v is null or c <> 1 or v <> 1").isEmpty():
        raise ValueError("chunks and vectors do not match one to one")
