"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Vectors are normalised, so that nearness by cosine is nearness by distance, and turned by one random
orthogonal matrix, after which any first d columns estimate a distance without bias.  Lists come
from spherical k-means on a bounded sample; every row is in the list of its nearest centre.  A
query probes the lists nearest to it (``PROBED`` of all; more until they hold ``ENOUGH`` rows): first the
``FIRST`` nearest of these, whose k-th best score is where the others start from.

Lists are packed into groups of about ``TILE_ROWS`` rows.  Rows and queries meet in tiles of a group, a
block of its rows and a block of its queries, so neither a hot list nor a hot query lands in one task.
In a tile, a list's columns are read in blocks of ``COLUMNS``.  After each, a hypothesis test drops the
candidates that are very unlikely to beat the query's k-th best so far: the columns read, at length one,
give a partial distance whose error is known from how many columns there are and how many are left.
What survives all columns is scored exactly, in double precision, on the original vectors, and raises
the query's k-th best for the lists that follow.

``PROBED`` is large because the vectors here lie almost evenly in 64 dimensions, where half of the lists
just give recall 0.9.  Clustered vectors need far fewer.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; neither do null ids.  Ties go to the smaller id.  Rows that
repeat an id are one query (its least vector) but candidates of their own, never of that id's query.
With fewer than k candidates all are returned; an empty table gives no rows.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import text as X

LIST_ROWS, MOST_LISTS, SAMPLE = 100, 2048, 16_384
PROBED, FIRST = 0.7, 0.06
#: rows that a query's lists hold at least, if there are so many
ENOUGH = 512
TILE_ROWS, TILE_QUERIES, STEP_ROWS = 2048, 1024, 512
#: columns of a block, and how many standard errors below the k-th best a candidate may seem to be
COLUMNS, DOUBT = 16, 2.6


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one, without overflow or underflow on the way."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, lists: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(turns):
        at = (sample @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        used, start = np.unique(at[order], return_index=True)
        sums = np.zeros_like(c)
        sums[used] = np.add.reduceat(sample[order], start)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def least(best: np.ndarray, read: int, dims: int) -> np.ndarray:
    """The cosine that the first ``read`` columns must show of a pair whose whole cosine is ``best``, but for ``DOUBT`` standard errors."""
    error = (1 - np.minimum(best * best, 1)) * np.sqrt((1 / read) * (1 - read / dims))
    return np.where(best < -1, -np.inf, best - DOUBT * error - 1e-6)


def scan(queries: np.ndarray, rows: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query, row) pairs that no test dropped, and how many were left after each block of columns.

    Both are unit vectors, already rotated; ``best`` is each query's k-th best cosine so far (below -1: none).
    """
    dims = rows.shape[1]
    cuts = [*range(0, dims, COLUMNS), dims]
    q = r = None
    dots, left = np.zeros((len(queries), len(rows))), []
    own, other = np.zeros(len(queries)), np.zeros(len(rows))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = queries[:, a:b], rows[:, a:b]
        own, other = own + (x * x).sum(1), other + (y * y).sum(1)
        bound = least(best, b, dims) if b < dims else best - 1e-12
        if q is None:
            dots += x @ y.T
            keep = dots >= (bound * np.sqrt(own))[:, None] * np.sqrt(other)[None, :] if b < dims else dots >= bound[:, None]
            left.append(int(np.count_nonzero(keep)))
            if left[-1] < 0.2 * keep.size or b == dims:
                q, r = np.nonzero(keep)
                dots = dots[q, r]
        else:
            dots = dots + np.einsum("ij,ij->i", x[q], y[r])
            keep = dots >= (bound[q] * np.sqrt(own[q] * other[r]) if b < dims else bound[q])
            q, r, dots = q[keep], r[keep], dots[keep]
            left.append(len(q))
    return q, r, left


def nearest(queries: np.ndarray, rows: np.ndarray, turn: np.ndarray, ids: tuple[np.ndarray, np.ndarray], lists: np.ndarray, probes: list[np.ndarray], best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k nearest rows in the probed lists, and the share of pairs left after each block of columns.

    ids: of queries and of rows; lists: each row's; probes: each query's, nearest first; best: its k-th best cosine so far.
    """
    turned_q, turned_r = queries @ turn, rows @ turn
    order = np.argsort(lists, kind="stable")
    names, first = np.unique(lists[order], return_index=True)
    at = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))
    asked: dict[int, list[int]] = {}
    rank: dict[int, int] = {}
    for i, p in enumerate(probes):
        for n, x in enumerate(p.tolist()):
            asked.setdefault(x, []).append(i)
            rank[x] = rank.get(x, 0) + n
    top = np.full((len(queries), k), -np.inf)
    best = best.copy()
    found = []
    left = np.zeros(-(-rows.shape[1] // COLUMNS))
    pairs = 0
    # the lists that are near to most of their queries come first
    for x in sorted(at.keys() & asked.keys(), key=lambda x: (rank[x] / len(asked[x]), x)):
        here = np.array(asked[x])
        for a in range(0, len(at[x]), STEP_ROWS):
            block = at[x][a : a + STEP_ROWS]
            q, r, counts = scan(turned_q[here], turned_r[block], best[here])
            left += counts
            pairs += len(here) * len(block)
            q, r = here[q], block[r]
            other = ids[0][q] != ids[1][r]
            q, r = q[other], r[other]
            if not len(q):
                continue
            # one plain sum for each pair, whatever stands beside it in the tile
            score = (queries[q] * rows[r]).sum(1)
            by = np.lexsort((ids[1][r], -score, q))
            q, r, score = q[by], r[by], score[by]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            near = place < k
            q, r, score, place = q[near], r[near], score[near], place[near]
            found.append((q, r, score))
            new = np.full_like(top, -np.inf)
            new[q, place] = score
            top = np.sort(np.concatenate([top, new], axis=1), axis=1)[:, -k:]
            best = np.maximum(best, top[:, 0])
    q, r, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    by = np.lexsort((ids[1][r], -score, q))
    q, r, score = q[by], r[by], score[by]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[near], r[near], score[near], left / max(pairs, 1)


def _vectors(column: pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.empty((0, 1))


def _tile(table: pa.Table, k: int) -> pa.Table:
    asks = np.array(table.column("asks").to_pylist(), dtype=bool)
    rows, queries = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
    q = r = np.empty(0, np.int64)
    score = np.empty(0)
    ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
    if len(rows) and len(queries):
        u, v = unit(_vectors(queries.column("v"))), unit(_vectors(rows.column("v")))
        probes = [np.array(p, dtype=np.int64) for p in queries.column("lists").to_pylist()]
        lists = np.array([p[0] for p in rows.column("lists").to_pylist()])
        q, r, score, _ = nearest(u, v, rotation(u.shape[1]), ids, lists, probes, queries.column("best").to_numpy(), k)
    return pa.table({"query_id": pa.array(ids[0][q], pa.int64()), "vec_id": pa.array(ids[1][r], pa.int64()), "score": pa.array(score, pa.float64())})


def search(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``asks`` holds."""
    spark = vectors.sparkSession
    doubles = F.col(vector).cast("array<double>")
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(doubles, lambda x: x != 0)
    usable = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), doubles.alias("x")).where(sound)
    usable = X.settled(usable, "vectors")
    widths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], empty)
    dims, n = widths[0]["d"], widths[0]["count"]
    usable = usable.where(F.size("x") == dims)
    lists = int(min(MOST_LISTS, max(1, n // LIST_ROWS)))

    def flat(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [flat(batch.column("x")) for batch in batches if len(batch)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([centres(unit(np.concatenate(found)), lists).tobytes()], pa.binary())], ["c"])

    # SAMPLE rows in one task; MOST_LISTS centres at most reach the driver and every task
    sample = usable.select("id", "x").orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).select("x")
    centre = np.frombuffer(sample.mapInArrow(learn, "c binary").first()["c"], np.float64).reshape(-1, dims)
    shared = spark.sparkContext.broadcast(centre)
    lists = len(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = flat(batch.column("x"))
            near = (unit(v) @ shared.value.T).argmax(1) if len(v) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(near.astype(np.int32))], ["id", "asks", "v", "list"])

    rows = X.settled(usable.mapInArrow(assign, "id long, asks boolean, v binary, list int"), "assigned")
    held = np.zeros(lists, dtype=np.int64)
    for r in rows.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    # neighbouring numbers share a group until it holds TILE_ROWS; a list with more has several blocks
    group = (np.cumsum(held) - held) // TILE_ROWS
    blocks = np.maximum(1, -(-np.bincount(group, weights=held).astype(np.int64) // TILE_ROWS))
    first, probed = (max(1, int(np.ceil(share * lists))) for share in (FIRST, PROBED))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            near = np.argsort(-(unit(_vectors(batch.column("v"))) @ shared.value.T), axis=1, kind="stable") if len(batch) else []
            # the id's own rows do not count, whatever lists they are in
            for i, order, copies in zip(range(len(batch)), near, batch.column("copies").to_pylist(), strict=True):
                enough = int(np.searchsorted(np.cumsum(held[order]), max(k, ENOUGH) + copies)) + 1
                for now, part in ((True, order[: max(first, enough)]), (False, order[max(first, enough) : max(probed, enough)])):
                    for g in np.unique(group[part]):
                        out.append((i, now, int(g), part[group[part] == g]))
            i, now, g, found = zip(*out, strict=True) if out else ((), (), (), ())
            ids, v = (batch.column(c).take(pa.array(i, pa.int64())) for c in ("id", "v"))
            yield pa.RecordBatch.from_arrays([ids, v, pa.array(now, pa.bool_()), pa.array(g, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["id", "v", "now", "grp", "lists"])

    copies = rows.groupBy("id").agg(F.min(F.when(F.col("asks"), F.col("v"))).alias("v"), F.count("*").alias("copies"))
    queries = copies.where(F.col("v").isNotNull()).mapInArrow(probe, "id long, v binary, now boolean, grp int, lists array<int>")
    queries = X.settled(queries, "probes")
    asked = {(r["now"], r["grp"]): r["count"] for r in queries.groupBy("now", "grp").count().collect()}
    split = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of_group = spark.createDataFrame([(i, int(g)) for i, g in enumerate(group)], "list int, grp int").coalesce(1)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, k)

    def meet(now: bool, looking: DataFrame) -> DataFrame:
        sizes = [(int(g), int(blocks[g]), -(-n // TILE_QUERIES)) for (when, g), n in asked.items() if when == now]
        # MOST_LISTS rows at most
        sizes = F.broadcast(spark.createDataFrame(sizes, "grp int, row_blocks int, query_blocks int").coalesce(1))
        placed = rows.join(F.broadcast(of_group), "list").join(sizes, "grp").select("grp", split("row_blocks").alias("rb"), every("query_blocks").alias("qb"), F.lit(False).alias("asks"), "id", "v", F.array("list").alias("lists"), F.lit(-2.0).alias("best"))
        looking = looking.where(F.col("now") == now).join(sizes, "grp").select("grp", every("row_blocks").alias("rb"), split("query_blocks").alias("qb"), F.lit(True).alias("asks"), "id", "v", "lists", "best")
        found = placed.unionByName(looking).groupBy("grp", "rb", "qb").applyInArrow(tile, "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    start = X.settled(meet(True, queries.withColumn("best", F.lit(-2.0))), "start")
    if not any(not now for now, _ in asked):
        return start.select("query_id", "rank", "vec_id", "score")
    bounds = start.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("best"))
    more = meet(False, queries.where("not now").join(bounds, "id", "left").fillna(-2.0, ["best"]))
    found = start.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
