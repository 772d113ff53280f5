"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers 0 .. N-1 that depend on the rows' ids and contents alone: hash
buckets of bounded size are numbered inside, and a running total of the buckets' counts lifts those
numbers.  A balanced Feistel network permutes the smallest domain of 2 ** even bits that holds N;
numbers that land outside 0 .. N-1 walk on along their cycle until they land inside.  The permuted
number p gives shard ``p mod shards`` and slot ``p div shards``, so shards differ by one row at
most, and ``row_number_of`` computes the row of any slot back.

Defined results: null texts and ids are values like any other; rows equal in id and text are
interchangeable and get different slots; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import text as X

TURNS = 6
BUCKET_ROWS = 50_000


def _round_key(seed: int, turn: int) -> np.uint64:
    return X.mix(np.array([(seed * 0x9E3779B97F4A7C15 + turn + 1) & ((1 << 64) - 1)], dtype=np.uint64))[0]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for turn in range(TURNS)[:: -1 if back else 1]:
        if back:
            left, right = right ^ (X.mix(left ^ _round_key(seed, turn)) & mask), left
        else:
            left, right = right, left ^ (X.mix(right ^ _round_key(seed, turn)) & mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permuted numbers of x (all in 0 .. n-1); ``back`` undoes it."""
    x = np.asarray(x, dtype=np.uint64)
    if n <= 1:
        return x.copy()
    bits = _half_bits(n)
    out = _once(x, bits, seed, back)
    while (off := np.flatnonzero(out >= np.uint64(n))).size:
        out[off] = _once(out[off], bits, seed, back)
    return out


def row_number_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row numbers that stand at the given places."""
    return permute(np.asarray(slot, np.uint64) * np.uint64(shards) + np.asarray(shard, np.uint64), n, seed, back=True)


def numbered(df: DataFrame, by: list[str], column: str = "row") -> tuple[DataFrame, int]:
    """df with gapless global row numbers that depend on the columns ``by``, and the number of rows."""
    with X.unused_names(df, "bucket", "place", "base") as (bucket, place, base):
        n = df.count()
        buckets = max(64, -(-n // BUCKET_ROWS))
        dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
        # at most n / BUCKET_ROWS rows of two numbers
        counts = dealt.groupBy(bucket).agg(F.count("*").alias(place))
        bases = counts.select(bucket, (F.sum(place).over(W.orderBy(bucket)) - F.col(place)).alias(base))
        bases = F.broadcast(bases) if buckets <= 100_000 else bases
        inside = dealt.withColumn(place, F.row_number().over(W.partitionBy(bucket).orderBy(*by)))
        out = inside.join(bases, bucket).withColumn(column, F.col(base) + F.col(place) - 1)
        return out.select(*df.columns, column), n


def shuffle(df: DataFrame, by: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with the columns shard (int) and slot (long); columns of these names are replaced."""
    df = df.drop("shard", "slot")
    with X.unused_names(df, "row") as (row,):
        rows, n = numbered(df, by, row)
        keep = df.columns
        schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = permute(batch.column(row).to_numpy(), n, seed)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array((p % np.uint64(shards)).astype(np.int32)), pa.array((p // np.uint64(shards)).astype(np.int64))], [*keep, "shard", "slot"])

        return rows.mapInArrow(run, schema)


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every document; size: UTF-8 bytes plus one."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = X.settled(docs.select(key, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")), "sizes")
    placed = shuffle(slim, [key, "size", "text_crc32"], shards, seed)
    return placed.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
