"""Exact vector search over row blocks: one matrix product for a block and a tile of queries, a bounded heap for each query.

A block is up to ``BLOCK`` ids and their vectors as one matrix, whatever the batches that the rows come in.  Blocks meet tiles of queries, so
a plan never holds a row for each pair of a query and a vector; a task keeps the best of each query over all its blocks, and only those are
shuffled and merged, first by groups of tasks and then by query.  Vectors are made into blocks where they are multiplied, one block at a
time; a table of blocks can be stored and searched again.

Vectors that are null, empty or hold null or non-finite components take no part, and vectors meet queries of their own length only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.layout import kept

#: rows of a block and bytes of its matrix, queries of a tile
BLOCK, BLOCK_BYTES, TILE = 4_096, 4 << 20, 1_024
#: numbers of queries' vectors, and rows of their heaps, that a task's Python holds; more queries are asked in so many passes over the vectors,
#: and beyond these, blocks are rows that meet rows of tiles
SENT, HELD, PASSES = 1 << 22, 1 << 20, 16
#: queries whose tiles are sent to every task; beyond, tiles and blocks meet partition by partition
MOST_QUERIES = 20_000
#: tiles a task keeps heaps for; with more, a heap is given out early and begun again
HEAPS = 32
#: groups of tasks whose heaps are merged before a query's are
GROUPS = 32
#: queries of a tile that are multiplied together, and what rounding to six places can add to a score
LINES, SLACK = 128, 1e-6


def packed(batches: Iterator[pa.RecordBatch], most: int = BLOCK, ordered: bool = True) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Batches (id, v, keep) as (ids, keep, matrix), a block of vectors of one length at a time."""
    held: dict[int, list[tuple[pa.Array, pa.Array, np.ndarray]]] = {}
    rows: dict[int, int] = {}

    def out(dims: int, room: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
        parts = held.pop(dims)
        ids, keep, m = pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        if len(ids) > room:
            held[dims] = [(ids[room:], keep[room:], m[room:])]
            ids, keep, m = ids[:room], keep[:room], m[:room]
        rows[dims] = rows.pop(dims) - len(ids)
        if ordered:
            by = pc.sort_indices(ids)
            ids, keep, m = ids.take(by), keep.take(by), m[by.to_numpy()]
        yield ids, keep, m

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes[sizes > 0]).tolist():
            of, room = np.flatnonzero(sizes == dims), max(1, min(most, BLOCK_BYTES // (8 * dims)))
            for at in range(0, len(of), room):
                part = pa.array(of[at : at + room])
                matrix = batch.column("v").take(part).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                whole = np.isfinite(matrix.astype(np.float64)).all(axis=1)
                part = part.filter(pa.array(whole))
                if len(part):
                    held.setdefault(dims, []).append((batch.column("id").take(part), batch.column("keep").take(part), matrix[whole]))
                    rows[dims] = rows.get(dims, 0) + len(part)
                if rows.get(dims, 0) >= room:
                    yield from out(dims, room)
        # vectors of many lengths do not add up
        while sum(rows.values()) > 2 * most:
            yield from out(max(held, key=rows.get), most)
    for dims in list(held):
        yield from out(dims, rows[dims])


def blocks(found: DataFrame, most: int = BLOCK, ordered: bool = True) -> DataFrame:
    """rows (id, v, keep) -> (ids, keep, dims, matrix), ids in order within a block if ``ordered``."""
    one = 8 if isinstance(found.schema["v"].dataType.elementType, T.DoubleType) else 4
    schema = T.StructType([T.StructField("ids", T.ArrayType(found.schema["id"].dataType)), T.StructField("keep", T.ArrayType(T.BooleanType())), T.StructField("dims", T.IntegerType()), T.StructField("matrix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keep, m in packed(batches, most, ordered):
            ends = pa.array([0, len(ids)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, keep), pa.array([m.shape[1]], pa.int32()), pa.array([m.astype(f"<f{one}").tobytes()], pa.binary())], schema.names)

    return found.select("id", "v", "keep").mapInArrow(run, schema)


def _matrix(raw: bytes | pa.Buffer, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<f{len(raw) // (rows * dims)}").reshape(rows, dims).astype(np.float64)


class Heap:
    """The ``most`` best (score rounded to six places, then smaller id) of each query of a tile, of scores of ``least`` at least."""

    def __init__(self, ids: pa.Array, most: int, least: float = -np.inf):
        self.ids, self.most = ids, most
        self.worst = np.full(len(ids), least)
        self.found: list[pa.Table] = []
        self.rows = 0

    def add(self, ids: pa.Array, keep: pa.Array, scores: np.ndarray, first: int = 0) -> None:
        """scores: of the tile's queries from ``first`` on x a block's ids."""
        worst = self.worst[first : first + len(scores)]
        # most queries find nothing better in a later block
        lines = np.flatnonzero(np.fmax.reduce(scores, axis=1, initial=-np.inf) >= worst - SLACK)
        if not len(lines):
            return
        scores = np.round(scores[lines], 6)
        among = scores >= worst[lines, None]
        many = np.flatnonzero(among.sum(axis=1) > self.most)
        if len(many):
            some = np.where(among[many], scores[many], -np.inf)
            cut = np.partition(some, -self.most, axis=1)[:, -self.most, None]
            better, level = some > cut, some == cut
            # the block's ids are in order, so the first of equal scores are the ones to stay
            level &= np.cumsum(level, axis=1) <= self.most - better.sum(axis=1, keepdims=True)
            among[many] &= better | level
        line, row = np.nonzero(among)
        at = pa.array(row)
        self.found.append(pa.table({"query": pa.array(lines[line] + first), "score": pa.array(scores[line, row]), "id": ids.take(at), "keep": keep.take(at)}))
        self.rows += len(row)
        full = np.flatnonzero(among.sum(axis=1) >= self.most)
        self.worst[first + lines[full]] = np.where(among[full], scores[full], np.inf).min(axis=1)
        if self.rows > 2 * self.most * len(self.ids):
            self.trim()

    def trim(self) -> pa.Table:
        table = pa.concat_tables(self.found).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query, score = table["query"].to_numpy(), table["score"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.most - 1
        self.worst[query[full]] = score[full]
        table = table.filter(pa.array(place < self.most))
        self.found, self.rows = [table], len(table)
        return table

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        """One batch, or none if nothing was found."""
        if not self.found:
            return
        table = self.trim().combine_chunks()
        column = lambda c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0)
        group = (TaskContext.get().partitionId() if TaskContext.get() else 0) % GROUPS
        yield pa.RecordBatch.from_arrays([self.ids.take(column("query")), column("id"), column("score"), column("keep"), pa.array(np.full(len(table), group, np.int32))], ["query_id", "id", "score", "keep", "grp"])


def best(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The ``most`` best rows of each group with their rank."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def merged(found: DataFrame, most: int) -> DataFrame:
    """found (query_id, id, score, keep, grp): what tasks kept -> the ``most`` best rows of each query with their rank."""
    if found.sparkSession.sparkContext.defaultParallelism > GROUPS:
        found = best(found, most, "query_id", "grp").drop("rank")
    return best(found.drop("grp"), most, "query_id")


def passes(*held: tuple[int, int]) -> int:
    """In how many passes no more than its bound is held of anything; held: (how much of it there is, its bound)."""
    return max(1, *(-(-much // bound) if bound else much * PASSES + 1 for much, bound in held))


def search(queries: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """queries (query_id, vector), found: rows (id, v, keep) or blocks of them -> (query_id, id, score, keep, rank), the ``most`` nearest of each query."""
    stored = "matrix" in found.columns
    n, numbers = queries.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0))), F.lit(0))).first()
    asked = queries.select(F.col("query_id").alias("id"), F.col("vector").alias("v"), F.lit(True).alias("keep"))
    kind = found.schema["ids"].dataType.elementType if stored else found.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType()), T.StructField("grp", T.IntegerType())])

    def tiles(some: DataFrame, n: int) -> DataFrame:
        return blocks(some.repartition(max(1, -(-n // TILE))), TILE, ordered=False).select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("matrix").alias("q_matrix"))

    def add(heap: Heap, asked: np.ndarray, ids: pa.Array, keep: pa.Array, matrix: np.ndarray) -> None:
        for at in range(0, len(asked), LINES):
            heap.add(ids, keep, asked[at : at + LINES] @ matrix.T, at)

    def opened(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        ids = batch.column("ids")[i].values
        return ids, batch.column("keep")[i].values, _matrix(batch.column("matrix")[i].as_buffer(), len(ids), batch.column("dims")[i].as_py())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[bytes, tuple[np.ndarray, Heap]] = {}
        for batch in batches:
            for i in range(len(batch)):
                dims, tile = batch.column("dims")[i].as_py(), batch.column("q_matrix")[i].as_py()
                if dims != batch.column("q_dims")[i].as_py():
                    continue
                if tile not in heaps:
                    if len(heaps) >= HEAPS:
                        yield from heaps.pop(next(iter(heaps)))[1].rows_out()
                    ids = batch.column("q_ids")[i].values
                    heaps[tile] = _matrix(tile, len(ids), dims), Heap(ids, most)
                asked, heap = heaps[tile]
                add(heap, asked, *opened(batch, i))
        for _, heap in heaps.values():
            yield from heap.rows_out()

    rounds = passes((numbers, SENT), (n * most, HELD))
    if rounds > PASSES:
        every = tiles(asked, n)
        return merged((found if stored else blocks(found)).crossJoin(F.broadcast(every) if n <= MOST_QUERIES else every).mapInArrow(met, schema), most)
    if rounds > 1:
        asked = kept(asked, "asked")

    def one(some: DataFrame) -> DataFrame:
        """The nearest for some of the queries, whose tiles go through the driver and to every task."""
        sent = found.sparkSession.sparkContext.broadcast(tiles(some, -(-n // rounds)).toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = [(ids.values, _matrix(matrix.as_buffer(), len(ids), dims.as_py())) for batch in sent.value.to_batches() for ids, dims, matrix in zip(*(batch.column(c) for c in ("q_ids", "q_dims", "q_matrix")))]
            heaps = [(asked, Heap(ids, most)) for ids, asked in each]
            for ids, keep, matrix in (opened(batch, i) for batch in batches for i in range(len(batch))) if stored else packed(batches):
                matrix = matrix.astype(np.float64, copy=False)
                for asked, heap in heaps:
                    if asked.shape[1] == matrix.shape[1]:
                        add(heap, asked, ids, keep, matrix)
            for _, heap in heaps:
                yield from heap.rows_out()

        return found.mapInArrow(run, schema)

    each = [one(asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) if rounds > 1 else asked) for r in range(rounds)]
    return merged(reduce(DataFrame.unionByName, each), most)
