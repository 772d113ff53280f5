"""DartMinHash near-duplicates: texts whose five-word shingles have a weighted Jaccard similarity of 0.8 or more.

A text is the weighted set of its five-word shingles (A-Z in lower case), each weighing as often as
it occurs.  Texts of fewer than five words are one shingle of all their words.

Signature.  Every shingle has an endless stream of hashed darts in the plane (weight, rank): in each
dyadic weight region they arrive by rank as a Poisson process whose rate is the region's width.  A
dart counts if it lies under the shingle's weight and before a rank limit chosen so that about
``k ln k + 2k`` darts count; it falls on one of ``k`` coordinates, each of which keeps its earliest
dart.  Texts with an empty coordinate double their limit.  Two texts agree on a coordinate with a
probability equal to their weighted Jaccard similarity.

Links.  Equal texts are one class from the start and go on as one representative.  Signatures are
cut into bands; texts that share a band go to a bucket.  In a bucket the text that meets the most
others in all its buckets leads, and every other is compared with it, once for all the buckets that
they share: signatures first, then the whole texts.  Following the most central leader that it is like
gives every text the label of a group.  Then, in every bucket whose other texts bear several labels,
all texts outside its largest group are compared with all the others, in tiles bounded in rows and
bytes, from the likeliest on.  A tile gives out one link of each label to each other that it is like, so
no pairs are emitted and no link between labels that share a bucket is lost.  Pairs whose signatures
agree very well or very badly are settled by them; all others are settled by exact weighted Jaccard on
the whole texts.  Classes are the connected components of the links between labels, found by
spreading least labels with pointer jumping.  A leader, text or label with a large share of all rows
stands on one side of plain equality joins only, whose other side the engine splits.

Defined results: null counts as empty; all empty texts are one class; rows of equal texts share a
class; repeated ids give one row each; null ids take part like any other row.  A class id is the
least id of the class (null if all its ids are).  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm import text as X

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
#: rows of one side of a tile, where what leaders leave apart is compared
TILE = 1024
#: and of text of one side
TILE_BYTES = 16 << 20
#: agreements (of BANDS * ROWS) from which on a pair is alike, and under which it is not; between, texts are compared
SURE, UNLIKE = 117, 80
#: text keys (32 bytes each) that may be sent to every task; more of them are joined by a shuffle
MOST_SENT = 200_000
_TO_UNIT = 2.0**-53


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _TO_UNIT


def weighted_shingles(raw: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight), sorted by row and hash."""
    low = X.LOWER[raw]
    starts, ends, first = X.words(low, offsets)
    h = X.span_hashes(low, starts, ends)
    counts = np.diff(first)
    rows = np.repeat(np.arange(len(counts)), counts)
    every = X.shingle_hashes(h, n)
    whole = rows[: len(every)] == rows[n - 1 :] if len(every) else np.empty(0, bool)
    row, shingle = rows[: len(every)][whole], every[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([X.mix(np.array([int(x) * (k + 3) & ((1 << 64) - 1) for k, x in enumerate(h[first[i] : first[i + 1]])], dtype=np.uint64)).sum(dtype=np.uint64) for i in short], dtype=np.uint64)
        row, shingle = np.append(row, short), np.append(shingle, extra)
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    if not len(row):
        return row, shingle, np.empty(0, np.float64)
    new = np.append(True, (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1]))
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row))).astype(np.float64)


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int = BANDS * ROWS) -> np.ndarray:
    """(n_rows, k) dart ids; rows without elements hold zeros.  Weights are any positive numbers."""
    out = np.zeros((n_rows, k), dtype=np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    todo = np.flatnonzero(total > 0)
    limit = np.zeros(n_rows)
    limit[todo] = (k * np.log(k) + 2 * k) / total[todo]
    # one cell for each element and dyadic weight region [0, 1), [1, 2), [2, 4), ... that its weight reaches
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    cell = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(cell)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    c_row, c_weight = row[cell], weight[cell]
    c_key = X.mix(element[cell] + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    while len(todo):
        ours = np.zeros(n_rows, dtype=bool)
        ours[todo] = True
        live = np.flatnonzero(ours[c_row])
        rank = np.zeros(len(live))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            dart = X.mix(c_key[live] + np.uint64(step * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(_unit(dart)) / width[live]
            inside = rank < limit[c_row[live]]
            live, rank, dart = live[inside], rank[inside], dart[inside]
            under = low[live] + _unit(X.mix(dart ^ np.uint64(0x8EBC6AF09C88C6E3))) * width[live] < c_weight[live]
            found.append((live[under], rank[under], dart[under]))
            step += 1
        at, ranks, darts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64))
        ids = X.mix(darts ^ np.uint64(0x589965CC75374CC3))
        slot = c_row[at] * k + (ids % np.uint64(k)).astype(np.int64)
        order = np.lexsort((ids, ranks, slot))
        slot, ids = slot[order], ids[order]
        lead = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.empty(0, bool)
        slot, ids = slot[lead], ids[lead]
        full = np.bincount(slot // k, minlength=n_rows) == k
        use = full[slot // k]
        out.reshape(-1)[slot[use]] = ids[use]
        todo = todo[~full[todo]]
        limit[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(signatures), 0)
    for r in range(rows):
        out = X.mix(out * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in X.slices(batch, "t"):
            keys = part.column("u").to_pylist()
            place = {u: i for i, u in reversed(list(enumerate(keys)))}
            one = part.take(pa.array(sorted(place.values())))
            at = {u: i for i, u in enumerate(one.column("u").to_pylist())}
            raw, offsets = X.flat(one.column("t"))
            signatures = dart_signatures(*weighted_shingles(raw, offsets), len(one))[[at[u] for u in keys]]
            short = (signatures & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("k"),
                    part.column("u"),
                    pa.array(np.diff(X.flat(part.column("t"))[1])),
                    pa.array([s.tobytes() if s.any() else None for s in short], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, BANDS * len(part) + 1, BANDS, dtype=np.int32), band_hashes(signatures).reshape(-1).view(np.int64)),
                ],
                ["k", "u", "size", "sig", "bands"],
            )


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - least
    return float(least / union) if union else 1.0


def _like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(o, l) of those texts o that are like their leader l, of (o, l, sa, sb, ta, tb)."""
    for batch in batches:
        for part in (one for wide in X.slices(batch, "tb") for one in X.slices(wide, "ta")):
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(len(part), -1) for c in ("sa", "sb"))
            same = np.count_nonzero(a == b, axis=1)
            like = same >= SURE
            open_ = np.flatnonzero((same >= UNLIKE) & ~like)
            texts = part.take(pa.array(open_))
            # a leader's rows stand together: its text is taken apart once
            lead, at = np.unique(np.array(texts.column("tb").dictionary_encode().indices), return_inverse=True, return_index=True)[1:] if len(open_) else (open_, open_)
            leaders = _bags(texts.column("tb").take(pa.array(lead)))
            like[open_] = [weighted_jaccard(x, leaders[y]) >= SIMILAR for x, y in zip(_bags(texts.column("ta")), at, strict=True)]
            yield part.select(["o", "l"]).filter(pa.array(like))


def small(keys: DataFrame) -> DataFrame:
    """Text keys, marked for broadcast if they are few."""
    keys = X.settled(keys, "asked")
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, offsets = X.flat(column)
    row, shingle, weight = weighted_shingles(raw, offsets)
    first = np.searchsorted(row, np.arange(len(column) + 1))
    return [(shingle[i:j], weight[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]


def _tile(table: pa.Table) -> pa.Table:
    """(a, b): one link between any two labels of which a row of the small groups and another row are alike.

    Candidates are tried from the likeliest on until one is like; pairs of an earlier common band are left to it.
    """
    table = table.combine_chunks()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(table), BANDS, ROWS)
    band = table.column("band")[0].as_py()
    u = table.column("u").to_pylist()
    _, place = np.unique(np.array([x.hex() for x in u]), return_inverse=True)
    label = table.column("c").to_pylist()
    _, part = np.unique(np.array([x.hex() for x in label]), return_inverse=True)
    few, main = (np.array(table.column(x).to_pylist(), dtype=bool) for x in ("few", "main"))
    others = np.flatnonzero(~few)
    bags = None
    out: set[tuple[bytes, bytes]] = set()
    for x in np.flatnonzero(few):
        # two rows of small components meet twice; the lesser one speaks for them
        near = others[(part[others] != part[x]) & (main[others] | (place[others] > place[x]))]
        equal = sig[near] == sig[x]
        same = np.count_nonzero(equal.reshape(len(near), -1), axis=1)
        new = np.flatnonzero(same >= UNLIKE)
        new = new[~equal[new, :band].all(2).any(1)]
        if not len(new):
            continue
        if bags is None:
            bags = _bags(table.column("t").chunk(0))
        met: set[int] = set()
        for i in new[np.argsort(-same[new], kind="stable")]:
            y = near[i]
            if part[y] not in met and (same[i] >= SURE or weighted_jaccard(bags[x], bags[y]) >= SIMILAR):
                met.add(part[y])
                out.add((min(label[x], label[y]), max(label[x], label[y])))
    left, right = zip(*sorted(out), strict=True) if out else ((), ())
    return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})


def _across(rest: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links between the labels that meet in a bucket; rest: (h, band, u, size, c) without the buckets' leaders.

    Those outside the bucket's largest group are compared with everyone, in tiles of about TILE rows and TILE_BYTES
    of text a side.
    """
    groups = rest.groupBy("h", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = groups.groupBy("h").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "c")).alias("top")).where("labels > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES)).cast("int")
    parts = parts.select("h", F.col("top.c").alias("top"), blocks(F.col("n"), F.col("size")).alias("js"), F.greatest(blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")), F.lit(1)).alias("is"))
    rows = rest.drop("size").join(parts, "h").join(known, "u")
    own = lambda count: F.pmod(F.xxhash64("u", F.lit(9)), F.col(count)).cast("int")
    main = F.col("c") == F.col("top")
    # a row stands on the right side once for every i, and one outside the largest group on the left side once for every j
    side = lambda few, i, j: F.struct(F.lit(few).alias("few"), i.alias("i"), j.alias("j"))
    right = F.transform(F.sequence(F.lit(0), F.col("is") - 1), lambda i: side(False, i, own("js")))
    left = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda j: side(True, own("is"), j))
    tiles = rows.select("h", main.alias("main"), "band", "u", "c", "sig", "t", F.explode(F.when(main, right).otherwise(F.concat(right, left))).alias("side"))
    return tiles.select("h", "side.*", "main", "band", "u", "c", "sig", "t").groupBy("h", "i", "j").applyInArrow(_tile, "a binary, b binary")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge list: its component's least node."""
    both = edges.select(F.explode(F.array(F.struct(F.col(a).alias("v"), F.col(b).alias("w")), F.struct(F.col(b).alias("v"), F.col(a).alias("w")))).alias("e")).select("e.*").where("v <> w").distinct()
    both, found = X.observed(both, "edges", n=F.count("*"))
    if not found["n"]:
        return both.select(F.col("v").alias("node"), F.col("w").alias("root"))
    roots = X.settled(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("v").alias("w"), F.col("root").alias("r")), "w").groupBy("v").agg(F.min("r").alias("r"))
        least = roots.join(near, "v").select("v", F.least("root", "r").alias("to"), "root")
        jump = roots.select(F.col("v").alias("to"), F.col("root").alias("far"))
        moved = least.join(jump, "to").select("v", F.least("to", "far").alias("root"), F.col("root").alias("was"))
        moved, found = X.observed(moved, "roots", n=F.count_if(F.col("root") != F.col("was")))
        roots = moved.select("v", "root")
        if not found["n"]:
            return roots.withColumnRenamed("v", "node")


def groups(sketches: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, c): the labels of texts that bear another's, and (node, root): the roots of labels that are linked.

    sketches: (u, size, sig, bands), one row each; texts: (u, t), any number of rows each.
    """
    spread = sketches.select("u", "size", F.posexplode("bands").alias("band", "h"))
    # one text alone in its bucket has no partner
    shared = spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # the text that meets the most others leads: a template rather than one of its many variants
    central = F.struct((-F.sum("n").over(W.partitionBy("u"))).alias("met"), F.xxhash64("u").alias("x"), "u")
    spread = X.settled(spread.join(shared, "h").select("h", "band", "size", central.alias("o")), "buckets")
    asked = spread.select("o.u").distinct()
    known = texts.join(small(asked), "u").groupBy("u").agg(F.first("t").alias("t"))
    known = X.settled(known.join(sketches.select("u", "sig"), "u"), "known")
    lead = spread.groupBy("h").agg(F.min("o").alias("l"))
    tied = X.settled(spread.join(lead, "h").where("o.u <> l.u"), "tied")
    a, b = (known.select(F.col("u").alias(n), F.col("sig").alias(f"s{n}"), F.col("t").alias(f"t{n}")) for n in "ab")
    pairs = tied.select("o", "l").distinct().select("o", "l", F.col("o.u").alias("a"), F.col("l.u").alias("b"))
    node = "struct<met: bigint, x: bigint, u: binary>"
    found = X.settled(pairs.join(a, "a").join(b, "b").select("o", "l", "sa", "sb", "ta", "tb").mapInArrow(_like, f"o {node}, l {node}"), "found")
    # leaders meet more others than those that follow them, so following them ends; what ends later gets another label and meets in _across
    first = X.settled(found.groupBy(F.col("o.u").alias("u")).agg(F.min("l").alias("l")).select("u", F.col("l.u").alias("c")), "followed")
    then = first.select(F.col("u").alias("c"), F.col("c").alias("d"))
    last = then.select(F.col("c").alias("d"), F.col("d").alias("e"))
    labels = X.settled(first.join(then, "c", "left").join(last, "d", "left").select("u", F.coalesce("e", "d", "c").alias("c")), "labels")
    rest = tied.select("h", "band", F.col("o.u").alias("u"), "size").join(labels, "u", "left").withColumn("c", F.coalesce("c", "u"))
    across = _across(X.settled(rest, "rest"), known)
    # the links to leaders, as links of labels
    a, b = (labels.select(F.col("u").alias(n), F.col("c").alias(f"c{n}")) for n in "ab")
    tie = found.select(F.col("o.u").alias("a"), F.col("l.u").alias("b")).join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    return labels, components(across.unionByName(tie))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, head, least, u) of every row: head tells whether its text leads its class, least is
    the least id of its text and u the text's key.  A class keeps its head's row with the least id."""
    X.small_batches(docs.sparkSession)
    # the copies of a text are one text from here on; its key is a 256-bit hash
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("u", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    k_type = docs.schema[key].dataType.simpleString()
    keys = X.settled(rows.mapInArrow(_sketch, f"k {k_type}, u binary, size bigint, sig binary, bands array<bigint>"), "sketched")
    ids = X.settled(keys.groupBy("u").agg(F.min("k").alias("least"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "ids")
    labels, roots = groups(ids.where("sig is not null").select("u", "size", "sig", "bands"), rows.select("u", "t"))
    named = ids.select("u", "least").join(labels, "u", "left").withColumn("node", F.coalesce("c", "u")).join(roots, "node", "left")
    named = X.settled(named.select("u", "least", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "u")).alias("m"))
    final = named.join(least, "root").select("u", F.col("m.least").alias("class_id"), (F.col("u") == F.col("m.u")).alias("head"), "least")
    return keys.select("k", "u").join(final, "u").select(F.col("k").alias(key), "class_id", "head", "least", "u")


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class, with the columns of docs.

    Of rows with one id and one text, that whose other columns come first as JSON.
    """
    with X.unused_names(docs, "u", "least", "row") as (u, least, row):
        heads = classes(docs, key, text).where("head").select(F.col("least").alias(least), F.col("u").alias(u)).distinct()
        rows = docs.withColumn(u, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
        same = (rows[u] == heads[u]) & rows[key].eqNullSafe(heads[least])
        found = rows.join(heads, same, "left_semi")
        others = [c for c in docs.columns if c not in (key, text)]
        one = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.to_json(F.struct(*(F.col(f"`{c}`") for c in others))) if others else F.lit(0))
        return found.groupBy(u).agg(one.alias(row)).select(f"{row}.*")
