"""LM scoring: a Katz backoff model of word pairs over all training documents.

Tokens are words with A-Z in lower case, then one end for each text.  Counts are discounted by
Good-Turing (counts up to ``LOW``), for single tokens and for pairs.  A token's probability is
looked up recursively: if its pair with the token before was seen, the discounted share of that
pair; else the backoff weight of the token before times the token's own probability; a token never
seen gets the mass that discounting freed.  Backoff weights are computed from all followers of a
history, so that the probabilities after every history sum to one over the V known tokens and one
unknown.

The model is two tables in the shared folder, partitioned by ``part``, and one row of totals:
``words`` (hash range: words, counts, factor on seen shares, backoff weight) and ``pairs`` (bucket of
histories: history, follower, count).  ``fit`` writes them, ``Model.load`` reads them again, and
``score_with`` scores any documents by them; ``score`` does both over one reading of the texts.

Layout.  Texts are read once into batches of about ``BATCH_BYTES``: a batch is one row with its words'
hashes and its texts as indexes into them.  Hash ranges add up the words and number them; the
batches are written again with counts and numbers in place of hashes.  Their distinct training pairs go to
buckets of histories, one row of the table each.  Scoring sends the distinct pairs of a batch to
the buckets and its words to the hash ranges, and gets counts and weights back in the same order.
All of these are sorted columns of numbers, stored byte plane by byte plane.  The number of buckets
follows the number of tokens; a history of more than a few buckets' share of tokens is split by its
followers, so no bucket depends on one frequent word.

Words are known by a 64-bit hash.  Defined results: null counts as empty; an empty text is one end;
null ids count as the empty text for ``train``; rows equal in id and text score alike; without
training tokens every score is 0; an empty table gives no rows; extra columns do not matter; a hash
range of 2^24 words or more is an error (65,536 ranges hold 10^12).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import text as X

BATCH_BYTES = 12 << 20
BUCKET_TOKENS = 3_000_000
LOW = 5
_INDEX = 24
_TOP = 1 << 40
START, END = _TOP - 1, _TOP - 2
PARTS = 64


def packed(a: np.ndarray) -> bytes:
    """An array byte plane by byte plane: small and sorted numbers leave planes of zeros."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not blob:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's factor for counts 0 .. LOW, from the numbers of things seen 1 .. LOW + 1 times; 1 where it cannot be had."""
    d = np.ones(LOW + 1)
    if not n or n[0] <= 0:
        return d
    rest = (LOW + 1) * n[LOW] / n[0]
    for r in range(1, LOW + 1):
        if n[r - 1] > 0 and n[r] > 0 and rest < 1:
            x = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest)
            if 0 < x < 1:
                d[r] = x
    return d


@dataclass(frozen=True)
class Unigrams:
    """Single-token probabilities by count; ``unknown`` for a token that was never seen."""

    total: int
    distinct: int
    factor: np.ndarray
    scale: float
    unknown: float

    @staticmethod
    def of(total: int, distinct: int, by_count: list[int]) -> Unigrams:
        if not total:
            return Unigrams(0, 0, np.ones(LOW + 1), 1.0, 1.0)
        d = discounts(by_count)
        freed = sum((1 - d[r]) * r * by_count[r - 1] for r in range(1, LOW + 1)) / total
        if freed > 0:
            return Unigrams(total, distinct, d, 1 / total, freed)
        return Unigrams(total, distinct, np.ones(LOW + 1), 1 / (total + 1), 1 / (total + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return np.where(c > 0, c * np.where(c <= LOW, self.factor[np.minimum(c, LOW)], 1.0) * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.total + 1.0 * (self.distinct + 1)))


def backoff(mass: np.ndarray, followers: np.ndarray, count: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor on seen shares, backoff weight) of histories.

    mass: the followers' own probability; followers: (histories, LOW) how many were seen 1 .. LOW times.
    """
    r = np.arange(1, LOW + 1)
    freed = (followers * ((1 - d[1:]) * r)).sum(1) / count
    nothing = freed <= 0
    freed = np.where(nothing, 1 / (count + 1), freed)
    seen = np.where(nothing, count / (count + 1), 1.0)
    left = 1 - mass
    closed = left <= 1e-12
    # histories that every token has followed keep nothing back
    return np.where(closed, seen / (1 - freed), seen), np.where(closed, 0.0, freed / np.where(closed, 1.0, left))


BATCH = "batch long, n int, learnt long, vocab binary, tok binary, lens binary, trains binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[tuple] = []
    size, number = 0, 0

    def row() -> pa.RecordBatch:
        nonlocal number
        words = np.concatenate([h for _, h, _, _ in held])
        vocab, tok = np.unique(words, return_inverse=True)
        lens = np.concatenate([n for _, _, n, _ in held]).astype(np.int32)
        trains = np.concatenate([t for _, _, _, t in held])
        keys = pa.concat_arrays([k for k, _, _, _ in held])
        lists = pa.ListArray.from_arrays(np.array([0, len(keys)], np.int32), keys)
        number += 1
        columns = [pa.array([(part << 32) + number], pa.int64()), pa.array([len(keys)], pa.int32()), pa.array([int(trains.sum())], pa.int64()), *(pa.array([packed(a)], pa.binary()) for a in (vocab, tok.astype(np.uint32), lens, trains.astype(np.uint8))), lists]
        return pa.RecordBatch.from_arrays(columns, ["batch", "n", "learnt", "vocab", "tok", "lens", "trains", "keys"])

    for batch in batches:
        for piece in X.slices(batch, "t"):
            raw, offsets = X.flat(piece.column("t"))
            low = X.LOWER[raw]
            starts, ends, first = X.words(low, offsets)
            held.append((piece.column("k"), X.span_hashes(low, starts, ends), np.diff(first), piece.column("train").to_numpy(zero_copy_only=False)))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield row()
                held, size = [], 0
    if held:
        yield row()


@dataclass
class Tokens:
    """A batch's token sequence in local numbers: words 0 .. v-1, END v, START v+1; count and number of each of them."""

    lens: np.ndarray
    now: np.ndarray
    before: np.ndarray
    train: np.ndarray
    v: int
    c: np.ndarray
    g: np.ndarray

    @staticmethod
    def of(row: dict, documents: int) -> Tokens:
        tok, lens, trains, c, g = (unpacked(row[k], kind) for k, kind in (("tok", "u4"), ("lens", "i4"), ("trains", "u1"), ("c", "u8"), ("g", "u8")))
        v = len(c)
        now = np.insert(tok.astype(np.int32), np.cumsum(lens), v)
        full = lens.astype(np.int64) + 1
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[np.cumsum(full) - full] = v + 1
        counts = np.concatenate([c.astype(np.int64), [documents, documents]])
        return Tokens(full, now, before, np.repeat(trains.astype(bool), full), v, counts, np.concatenate([g, np.array([END, START], np.uint64)]))


def _ranges(vocab: np.ndarray, buckets: int) -> np.ndarray:
    """Edges of the hash ranges in sorted hashes."""
    place = (vocab >> np.uint64(48)).astype(np.int64) * buckets >> 16
    return np.searchsorted(place, np.arange(buckets + 1))


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, kind) for k, (v, kind) in columns.items()})


def _joined(blobs: list[bytes], kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(unpacked(b, kind) for b in blobs)])


def _word_requests(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            vocab, tok, lens, trains = (unpacked(r[c], k) for c, k in (("vocab", "u8"), ("tok", "u4"), ("lens", "i4"), ("trains", "u1")))
            n = np.bincount(tok[np.repeat(trains.astype(bool), lens)], minlength=len(vocab)).astype(np.uint32)
            edges = _ranges(vocab, buckets)
            used = np.flatnonzero(np.diff(edges)).tolist()
            cut = [slice(edges[b], edges[b + 1]) for b in used]
            out = {"batch": ([r["batch"]] * len(cut), pa.int64()), "bucket": (used, pa.int32()), "w": ([packed(vocab[x]) for x in cut], pa.binary()), "n": ([packed(n[x]) for x in cut], pa.binary())}
            yield from _rows(out).to_batches()


REQUESTS = "batch long, bucket int, w binary, n binary"
COUNTS = "batch long, bucket int, w binary, c binary, g binary, total long, seen long, by_count array<long>"


def _word_counts(table: pa.Table) -> pa.Table:
    """Adds up one hash range: a row without batch holds its words and totals, the others are the batches' answers."""
    bucket = table.column("bucket")[0].as_py()
    asked = [unpacked(b, "u8") for b in table.column("w").to_pylist()]
    words, at = np.unique(np.concatenate(asked), return_inverse=True)
    c = np.bincount(at, weights=_joined(table.column("n").to_pylist(), "u4"), minlength=len(words)).astype(np.uint64)
    known = c > 0
    if known.sum() >= 1 << _INDEX:
        raise ValueError("a hash range holds too many words")
    number = np.where(known, np.cumsum(known) - 1 + (bucket << _INDEX), 0).astype(np.uint64)
    edges = np.cumsum([0, *map(len, asked)])
    parts = [at[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    by = [int((c == r).sum()) for r in range(1, LOW + 2)]
    n = len(parts)
    return _rows(
        {
            "batch": ([None, *table.column("batch").to_pylist()], pa.int64()),
            "bucket": ([bucket] * (n + 1), pa.int32()),
            "w": ([packed(words[known])] + [None] * n, pa.binary()),
            "c": ([packed(c[known]), *(packed(c[p]) for p in parts)], pa.binary()),
            "g": ([None, *(packed(number[p]) for p in parts)], pa.binary()),
            "total": ([int(c.sum())] + [0] * n, pa.int64()),
            "seen": ([int(known.sum())] + [0] * n, pa.int64()),
            "by_count": ([by] + [[0] * (LOW + 1)] * n, pa.list_(pa.int64())),
        }
    )


def _word_answers(asked: pa.Table, words: pa.Table) -> pa.Table:
    """Counts and numbers of the words that batches ask one hash range of a stored model for."""
    own, count = _joined(words.column("w").to_pylist(), "u8"), _joined(words.column("c").to_pylist(), "u8")
    cs, gs = [], []
    for row in asked.to_pylist():
        w = unpacked(row["w"], "u8")
        at = np.searchsorted(own, w)
        hit = (at < len(own)) & (np.append(own, np.uint64(0))[at] == w)
        cs.append(packed(np.where(hit, np.append(count, np.uint64(0))[at], np.uint64(0))))
        gs.append(packed(np.where(hit, at + (row["bucket"] << _INDEX), 0).astype(np.uint64)))
    return _rows({"batch": (asked.column("batch").to_pylist(), pa.int64()), "bucket": (asked.column("bucket").to_pylist(), pa.int32()), "c": (cs, pa.binary()), "g": (gs, pa.binary())})


def _number(left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts and numbers in place of a batch's hashes."""
    rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    for name in ("c", "g"):
        left = left.append_column(name, pa.array([packed(_joined([r[name] for r in rows], "u8"))], pa.binary()))
    return left.drop_columns(["vocab"])


@dataclass
class Pairs:
    """Distinct pairs of local tokens in the order of their buckets; if asked for, each token's place among them (-1: none)."""

    h: np.ndarray
    w: np.ndarray
    n: np.ndarray
    bucket: np.ndarray
    of_token: np.ndarray | None

    @staticmethod
    def of(t: Tokens, which: np.ndarray, total: int, buckets: int, places: bool = False) -> Pairs:
        span = t.v + 2
        every = t.before[which].astype(np.int64)
        every *= span
        every += t.now[which]
        keys, n = np.unique(every, return_counts=True)
        h, w = keys // span, keys % span
        # a frequent history is in several buckets, by follower
        parts = np.maximum(1, np.ceil(t.c * (buckets / (4.0 * max(total, 1))))).astype(np.uint64)
        turn = X.mix(t.g[w]) % parts[h]
        bucket = (X.mix(t.g[h] * np.uint64(31) + turn * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        # keys are sorted already
        order = np.argsort(bucket, kind="stable")
        of_token = None
        if places:
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            of_token = np.full(len(t.now), -1, dtype=np.int32)
            of_token[which] = place[np.searchsorted(keys, every)]
        return Pairs(h[order], w[order], n[order], bucket[order], of_token)

    def cut(self) -> list[tuple[int, slice]]:
        """The buckets with pairs and where these stand."""
        found, first, n = np.unique(self.bucket, return_index=True, return_counts=True)
        return [(b, slice(x, x + k)) for b, x, k in zip(found.tolist(), first.tolist(), n.tolist(), strict=True)]


PAIRS = "batch long, bucket int, h binary, n_h binary, w binary, c_w binary, n binary"


def _pair_requests(batches: Iterator[pa.RecordBatch], documents: int, total: int, buckets: int, learn: bool) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of a batch: those learnt from with counts, or all of known tokens, to be looked up."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            t = Tokens.of(row, documents)
            p = Pairs.of(t, t.train if learn else (t.c[t.now] > 0) & (t.c[t.before] > 0), total, buckets)
            for b, s in p.cut():
                hs, sizes = np.unique(p.h[s], return_counts=True)
                more = [packed(t.c[p.w[s]].astype(np.uint64)), packed(p.n[s].astype(np.uint32))] if learn else [None, None]
                blobs = zip(("h", "n_h", "w", "c_w", "n"), (packed(t.g[hs]), packed(sizes.astype(np.uint32)), packed(t.g[p.w[s]]), *more), strict=True)
                yield from _rows({"batch": ([row["batch"]], pa.int64()), "bucket": ([b], pa.int32()), **{k: ([x], pa.binary()) for k, x in blobs}}).to_batches()
            # the next batch's arrays do not come on top of these
            del row, t, p


TABLE = "bucket int, h binary, n_h binary, w binary, c binary, count binary, followers binary, mass binary, by_count array<long>"


def _pair_counts(table: pa.Table, unigrams: Unigrams) -> pa.Table:
    """Adds up one bucket's pairs, and for every history its count, its followers by count and their own probability."""
    get = lambda name, kind: _joined(table.column(name).to_pylist(), kind)
    hs, dense = np.unique(get("h", "u8"), return_inverse=True)
    h = np.repeat(dense, get("n_h", "u4")).astype(np.uint64)
    keys, one, at = np.unique((h << np.uint64(40)) | get("w", "u8"), return_index=True, return_inverse=True)
    c = np.bincount(at, weights=get("n", "u4"), minlength=len(keys)).astype(np.int64)
    of = (keys >> np.uint64(40)).astype(np.int64)
    low = [np.bincount(of[c == r], minlength=len(hs)) for r in range(1, LOW + 1)]
    blobs = {
        "h": packed(hs),
        "n_h": packed(np.bincount(of, minlength=len(hs)).astype(np.uint32)),
        "w": packed(keys & np.uint64(_TOP - 1)),
        "c": packed(c.astype(np.uint64)),
        "count": packed(np.bincount(of, weights=c, minlength=len(hs)).astype(np.uint64)),
        "followers": packed(np.stack(low, axis=1).astype(np.uint32).ravel()),
        "mass": packed(np.bincount(of, weights=unigrams.p(get("c_w", "u8")[one]), minlength=len(hs))),
    }
    by = [int((c == r).sum()) for r in range(1, LOW + 2)]
    return _rows({"bucket": ([table.column("bucket")[0].as_py()], pa.int32()), **{k: ([x], pa.binary()) for k, x in blobs.items()}, "by_count": ([by], pa.list_(pa.int64()))})


HISTORIES = "bucket int, source int, h binary, count binary, followers binary, mass binary"


def _histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's histories, dealt to the hash ranges of their words; START goes to range -1."""
    for batch in batches:
        for row in batch.to_pylist():
            h, count, followers, mass = (unpacked(row[k], kind) for k, kind in (("h", "u8"), ("count", "u8"), ("followers", "u4"), ("mass", "f8")))
            followers = followers.reshape(-1, LOW)
            place = np.where(h == START, -1, (h >> np.uint64(_INDEX)).astype(np.int64))
            for b in np.unique(place).tolist():
                at = place == b
                blobs = {"h": packed(h[at]), "count": packed(count[at]), "followers": packed(followers[at].ravel()), "mass": packed(mass[at])}
                yield from _rows({"bucket": ([b], pa.int32()), "source": ([row["bucket"]], pa.int32()), **{k: ([x], pa.binary()) for k, x in blobs.items()}}).to_batches()


WORDS = "bucket int, w binary, c binary, seen binary, weight binary"


def _weights(words: pa.Table, parts: pa.Table, d: np.ndarray) -> pa.Table:
    """The words of one hash range with their backoff weights, from the parts of their histories."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["source"])
    hs, at = np.unique(_joined([r["h"] for r in rows], "u8"), return_inverse=True)
    add = lambda x: np.bincount(at, weights=x, minlength=len(hs))
    followers = _joined([r["followers"] for r in rows], "u4").reshape(-1, LOW)
    low = np.stack([add(followers[:, r]) for r in range(LOW)], axis=1)
    seen, weight = backoff(add(_joined([r["mass"] for r in rows], "f8")), low, add(_joined([r["count"] for r in rows], "u8")), d)
    bucket = (words if len(words) else parts).column("bucket")[0].as_py()
    own = {k: words.column(k)[0].as_py() if len(words) else b"" for k in ("w", "c")}
    return _rows({"bucket": ([bucket], pa.int32()), **{k: ([x], pa.binary()) for k, x in own.items()}, "seen": ([packed(seen)], pa.binary()), "weight": ([packed(weight)], pa.binary())})


def _weight_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            c, g = unpacked(row["c"], "u8"), unpacked(row["g"], "u8")
            g = g[c > 0]
            place = (g >> np.uint64(_INDEX)).astype(np.int64)
            for b in np.unique(place).tolist():
                index = (g[place == b] & np.uint64((1 << _INDEX) - 1)).astype(np.uint32)
                yield from _rows({"batch": ([row["batch"]], pa.int64()), "bucket": ([b], pa.int32()), "i": ([packed(index)], pa.binary())}).to_batches()


ANSWERS = "batch long, bucket int, c binary, seen binary, weight binary"


def _answers(asked: pa.Table, **blobs: list[bytes]) -> pa.Table:
    none = [None] * len(asked)
    ids = {"batch": (asked.column("batch").to_pylist(), pa.int64()), "bucket": (asked.column("bucket").to_pylist(), pa.int32())}
    return _rows({**ids, **{k: (blobs.get(k, none), pa.binary()) for k in ("c", "seen", "weight")}})


def _weight_answers(asked: pa.Table, words: pa.Table) -> pa.Table:
    seen, weight = (_joined(words.column(k).to_pylist(), "f8") for k in ("seen", "weight"))
    at = [unpacked(b, "u4") for b in asked.column("i").to_pylist()]
    return _answers(asked, seen=[packed(seen[i]) for i in at], weight=[packed(weight[i]) for i in at])


def _pair_answers(asked: pa.Table, pairs: pa.Table) -> pa.Table:
    """How often the pairs that batches ask one bucket for were seen."""
    h, n_h, w, c = (_joined(pairs.column(k).to_pylist(), kind) for k, kind in (("h", "u8"), ("n_h", "u4"), ("w", "u8"), ("c", "u8")))
    keys = (np.repeat(np.arange(len(h), dtype=np.uint64), n_h) << np.uint64(40)) | w
    # what is not in the table finds the row behind it, whose key is no pair's
    h, keys, c = np.append(h, np.uint64(_TOP)), np.append(keys, np.uint64(2**64 - 1)), np.append(c, np.uint64(0))
    out = []
    for row in asked.to_pylist():
        hs = unpacked(row["h"], "u8")
        place = np.searchsorted(h, hs)
        place = np.where(h[place] == hs, place, len(h)).astype(np.uint64)
        wanted = (np.repeat(place, unpacked(row["n_h"], "u4")) << np.uint64(40)) | unpacked(row["w"], "u8")
        at = np.searchsorted(keys, wanted)
        out.append(packed(np.where(keys[at] == wanted, c[at], 0).astype(np.uint64)))
    return _answers(asked, c=out)


def _scores(left: pa.Table, right: pa.Table, model: Model, key: str) -> pa.Table:
    """The rows of one batch; right holds its weights (rows with weights) and the counts of its pairs."""
    rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    row = left.to_pylist()[0]
    t = Tokens.of(row, model.documents)
    u, d = model.unigrams, model.factor
    pairs = Pairs.of(t, (t.c[t.now] > 0) & (t.c[t.before] > 0), u.total, model.pair_buckets, places=True)
    count = np.append(_joined([r["c"] for r in rows if r["weight"] is None], "u8").astype(np.int64), 0)
    seen, weight = np.ones(t.v + 2), np.ones(t.v + 2)
    known = np.flatnonzero(t.c[: t.v] > 0)
    seen[known], weight[known] = (_joined([r[k] for r in rows if r["weight"] is not None], "f8") for k in ("seen", "weight"))
    if model.documents:
        seen[t.v + 1], weight[t.v + 1] = model.start
    n = count[pairs.of_token]
    share = n * np.where(n <= LOW, d[np.minimum(n, LOW)], 1.0) / np.maximum(t.c[t.before], 1) * seen[t.before]
    prob = np.where(n > 0, share, u.p(t.c)[t.now] * weight[t.before])
    logs, base = np.log10(prob), u.base(t.c)[t.now]
    edge = np.cumsum(t.lens) - t.lens
    # summed text by text, so that equal texts score alike wherever they stand
    spans = list(zip(edge.tolist(), (edge + t.lens).tolist(), strict=True))
    return pa.table(
        {
            key: pa.array(row["keys"], left.schema.field("keys").type.value_type),
            "held_out": pa.array(~unpacked(row["trains"], "u1").astype(bool)),
            "n_tokens": pa.array(t.lens),
            "n_known": pa.array(np.add.reduceat((t.c[t.now] > 0).astype(np.int64), edge)),
            "train_tokens": pa.array([u.total] * len(spans), pa.int64()),
            "base_score": pa.array([base[a:b].sum() for a, b in spans]),
            "score": pa.array([logs[a:b].sum() for a, b in spans]),
        }
    )


@dataclass(frozen=True)
class Model:
    """The figures of a stored model; its tables lie under ``path``."""

    path: str
    unigrams: Unigrams
    factor: np.ndarray
    documents: int
    buckets: int
    pair_buckets: int
    start: tuple[float, float]

    @staticmethod
    def of(path: str, figures: dict, start: tuple[float, float]) -> Model:
        unigrams = Unigrams.of(figures["total"], figures["known"], figures["by_count"])
        return Model(path, unigrams, discounts(figures["by_pair"]), figures["documents"], figures["buckets"], figures["pair_buckets"], start)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model.of(path, spark.read.parquet(f"{path}/figures").collect()[0].asDict(), _start(spark, path))

    def words(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/words", WORDS)

    def pairs(self, spark: SparkSession) -> DataFrame:
        return _table(spark, f"{self.path}/pairs", TABLE)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, part int").parquet(path).drop("part")


def _start(spark: SparkSession, path: str) -> tuple[float, float]:
    row = _table(spark, f"{path}/words", WORDS).where("bucket = -1").select("seen", "weight").collect()
    return (float(unpacked(row[0][0], "f8")[0]), float(unpacked(row[0][1], "f8")[0])) if row else (1.0, 1.0)


def _write(df: DataFrame, path: str) -> None:
    df.withColumn("part", F.pmod("bucket", F.lit(PARTS))).write.partitionBy("part").option("compression", "zstd").parquet(path)


def _read(docs: DataFrame, train: Column, key: str, text: str, folder: str) -> DataFrame:
    X.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("t"))
    return X.stored(rows.mapInArrow(_batches, f"{BATCH}, keys array<{docs.schema[key].dataType.simpleString()}>"), f"{folder}/batches")


def _numbered(batches: DataFrame, answers: DataFrame, folder: str) -> DataFrame:
    """The batches with numbers for hashes; the earlier form is deleted."""
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in batches.schema if f.name != "vocab"]
    out = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_number, ", ".join([*kept, "c binary", "g binary"]))
    out = X.stored(out, f"{folder}/numbered")
    X.dropped(batches.sparkSession, f"{folder}/batches")
    X.release(batches.sparkSession)
    return out


def _learn(batches: DataFrame, path: str, folder: str) -> tuple[Model, DataFrame]:
    """The model of all batches, written under path, and the batches numbered by it."""
    spark = batches.sparkSession
    size, documents = batches.agg(F.coalesce(F.sum(F.octet_length("tok")), F.lit(0)), F.coalesce(F.sum("learnt"), F.lit(0))).collect()[0]
    # packed tokens take two to three bytes; the numbers of buckets follow the corpus
    buckets = int(min(1 << 16, max(8, 2 * size // BUCKET_TOKENS // 4)))
    pair_buckets = int(max(8, size // 2 // BUCKET_TOKENS * 2))
    asked = batches.select("batch", "vocab", "tok", "lens", "trains").mapInArrow(lambda it: _word_requests(it, buckets), REQUESTS)
    counted = X.stored(asked.groupBy("bucket").applyInArrow(_word_counts, COUNTS), f"{folder}/counts")
    sums = [F.coalesce(F.sum(F.element_at("by_count", r + 1)), F.lit(0)) for r in range(LOW + 1)]
    total, known, *by = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0)), *sums).collect()[0]
    # every training text ends once; its end is one more token
    by = [int(n) + (documents == r + 1) for r, n in enumerate(by)]
    total, known = int(total) + documents, int(known) + (documents > 0)
    unigrams = Unigrams.of(total, known, by)
    numbered = _numbered(batches, counted.where("batch is not null").select("batch", "bucket", "c", "g"), folder)

    def counts(table: pa.Table) -> pa.Table:
        return _pair_counts(table, unigrams)

    wanted = numbered.drop("keys").mapInArrow(lambda it: _pair_requests(it, documents, total, pair_buckets, True), PAIRS)
    _write(wanted.groupBy("bucket").applyInArrow(counts, TABLE), f"{path}/pairs")
    del wanted
    X.release(spark)
    pairs = _table(spark, f"{path}/pairs", TABLE)
    by_pair = [int(n) for n in pairs.agg(*sums).collect()[0]]
    d = discounts(by_pair)

    def weights(left: pa.Table, right: pa.Table) -> pa.Table:
        return _weights(left, right, d)

    parts = pairs.select("bucket", "h", "count", "followers", "mass").mapInArrow(_histories, HISTORIES)
    words = counted.where("batch is null").select("bucket", "w", "c")
    _write(words.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(weights, WORDS), f"{path}/words")
    X.dropped(spark, f"{folder}/counts")
    figures = {"total": total, "known": known, "documents": documents, "buckets": buckets, "pair_buckets": pair_buckets, "by_count": by, "by_pair": by_pair}
    kinds = "total long, known long, documents long, buckets int, pair_buckets int, by_count array<long>, by_pair array<long>"
    spark.createDataFrame([tuple(figures.values())], kinds).coalesce(1).write.parquet(f"{path}/figures")
    return Model.of(path, figures, _start(spark, path)), numbered


def _scored(numbered: DataFrame, model: Model, key: str, folder: str) -> DataFrame:
    spark = numbered.sparkSession
    lean = numbered.drop("keys")
    total, documents, pair_buckets = model.unigrams.total, model.documents, model.pair_buckets
    asked = lean.mapInArrow(lambda it: _pair_requests(it, documents, total, pair_buckets, False), PAIRS).drop("c_w", "n")
    table = model.pairs(spark).select("bucket", "h", "n_h", "w", "c")
    pairs = X.stored(asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_pair_answers, ANSWERS), f"{folder}/counted")
    words = lean.select("batch", "c", "g").mapInArrow(_weight_requests, "batch long, bucket int, i binary")
    table = model.words(spark).where("bucket >= 0").select("bucket", "seen", "weight")
    weights = X.stored(words.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_weight_answers, ANSWERS), f"{folder}/weights")
    del asked, table, words
    X.release(spark)
    key_type = numbered.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(left, right, model, key)

    return numbered.groupBy("batch").cogroup(pairs.unionByName(weights).groupBy("batch")).applyInArrow(scores, schema)


def fit(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Model:
    """The model of all documents, its tables written under ``path`` (a new folder that all executors share)."""
    folder = X.shared_dir(docs.sparkSession)
    model, _ = _learn(_read(docs, F.lit(True), key, text, folder), path, folder)
    X.dropped(docs.sparkSession, folder)
    return model


def score_with(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``score`` for documents that the model was not learnt from (held_out is true)."""
    spark, folder, buckets = docs.sparkSession, X.shared_dir(docs.sparkSession), model.buckets
    batches = _read(docs, F.lit(False), key, text, folder)
    asked = batches.select("batch", "vocab", "tok", "lens", "trains").mapInArrow(lambda it: _word_requests(it, buckets), REQUESTS).drop("n")
    words = model.words(spark).where("bucket >= 0").select("bucket", "w", "c")
    answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_word_answers, "batch long, bucket int, c binary, g binary")
    return _scored(_numbered(batches, answers, folder), model, key, folder)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``train`` says which are learnt from.  The model stays under ``path``; without one its tables are deleted once used.
    """
    folder = X.shared_dir(docs.sparkSession)
    model, numbered = _learn(_read(docs, train, key, text, folder), path or f"{folder}/model", folder)
    out = _scored(numbered, model, key, folder)
    if not path:
        X.dropped(docs.sparkSession, f"{folder}/model")
    return out
