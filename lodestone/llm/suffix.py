"""Exact removal of long byte strings that a corpus repeats, by suffix arrays over anchored parts of it.

A string of ``LENGTH`` bytes that starts at a byte is that byte's *window*.  Among the ``GRAM``-byte runs of a
window the one with the least hash (the first, if several have it) is its *anchor*.  Equal windows have
equal anchors at equal places, so they can only meet where anchors meet.  Neighbouring windows with one
anchor form a *part* of a text, of n windows and n + LENGTH - 1 bytes; windows belong to one part each.

1. Texts become parts (place, anchor hash, hash of all its bytes); parts whose anchor occurs once are gone.
2. Equal parts are settled once, with their number of copies.  Their bytes are fetched from one text each.
3. Parts are dealt by anchor.  A task builds the suffix array of a chunk of parts by two-stage sorting: it
   sorts directly only the suffixes smaller than their successors, and induces the others in one scan over
   the buckets of first bytes.  Neighbours in the array that share ``LENGTH`` bytes are one string; where
   such a run weighs two copies or more, its windows are repeated.
4. The repeated windows of a part go back to all its places, and each text drops the bytes they cover.

Anchors shared by more than ``MANY`` different parts (a frequent line between different neighbours) are
split: windows are dealt by the place of the anchor in them, eight places and then one place at a time,
together with all bytes that such windows share.  The last step leaves only equal windows together, so
no anchor fills a task however often it occurs.

Defined results: null texts count as empty; texts under LENGTH bytes lose nothing; equal texts lose all of
their bytes alike, if they have LENGTH bytes; rows repeat as they come, null keys included; an empty table
gives an empty table.  Only the key and the text are read, so further columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import text as X

#: bytes of a string that may not occur twice, and of an anchor within it
LENGTH, GRAM = 200, 64
#: different parts of one anchor beyond which its windows are split by the anchor's place
MANY = 500
#: places of the anchor that are dealt together, from one splitting to the next
WIDTHS = (8, 1)
#: windows whose suffixes are sorted at a time (more where one anchor's parts have more)
CHUNK = 1 << 19
#: bytes of a long text that are cut into parts at a time
PIECE = 1 << 18
#: texts that a worker takes at a time, at most
BATCH = 2_048
_MULTIPLIER = 0xB5297A4D3F84D5B5


# ---- suffix arrays ----


def words_at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders like them; raw has eight bytes to spare at its end."""
    eight = np.ndarray(len(raw) - 7, dtype=">u8", buffer=raw.data, strides=(1,))
    return eight[places].astype(np.uint64)


def sorted_directly(raw: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places by the ``depth`` bytes that follow them, eight more at a time within those still tied."""
    word = words_at(raw, places)
    by = np.argsort(word, kind="stable")
    out, word = places[by], word[by]
    at = np.arange(len(out))
    new = np.ones(len(out), dtype=bool)
    new[1:] = word[1:] != word[:-1]
    done = 8
    while True:
        # only places that share all bytes so far with a neighbour go on
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, new = at[tied], new[tied]
        if not len(at) or done >= depth:
            return out
        word = words_at(raw, out[at] + done)
        group = np.cumsum(new)
        lead = word[np.flatnonzero(new)][group - 1]
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[word != lead]] = True
        unsure = np.flatnonzero(mixed[group])
        if len(unsure):
            by = unsure[np.lexsort((word[unsure], group[unsure]))]
            out[at[unsure]], word[unsure] = out[at[by]], word[by]
        new[1:] |= word[1:] != word[:-1]
        done += 8


def suffix_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes at the first ``windows`` places of each part [start, end), in the order of their first ``depth`` bytes.

    raw holds the parts one after the other, each followed by one zero byte, and depth + 16 zero bytes at the end.  A part
    has ``windows + depth - 1`` bytes, so what follows its windows serves only to sort them.
    """
    n = int(ends[-1]) + 1
    step = np.sign(raw[:n].astype(np.int16) - raw[1 : n + 1])
    step[ends] = 1  # a part's end is smaller than all: equal bytes before it fall towards it
    # equal bytes take the type of the byte after them
    set_at = np.flatnonzero(step)
    smaller = np.repeat(step[set_at] < 0, np.diff(np.concatenate(([-1], set_at))))  # than their successor
    # of what follows the windows, suffixes up to the first that is sorted directly (or the end) are needed
    direct = np.flatnonzero(smaller)
    last = starts + windows - 1
    after = np.searchsorted(direct, last)
    stop = np.where(after < len(direct), direct[np.minimum(after, len(direct) - 1)], ends) if len(direct) else ends
    stop = np.minimum(stop, ends)
    wanted = np.zeros(n + 1, dtype=np.int8)
    wanted[starts] += 1
    wanted[stop + 1] -= 1
    wanted = np.cumsum(wanted[:n]).astype(bool)
    seeds = stop[stop == ends]
    first = np.zeros(n, dtype=bool)
    first[starts] = True

    kept = sorted_directly(raw, np.flatnonzero(smaller & wanted), depth)
    heads = np.searchsorted(raw[kept], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        """Puts the larger predecessors of places, in their order, at the ends of their buckets."""
        before = found[~first[found]] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        of = raw[before]
        by = np.argsort(of, kind="stable")
        before, of = before[by], of[by]
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for c, run in zip(of[np.append(0, cuts)].tolist(), np.split(before, cuts)):
            induced[c].append(run)

    if len(seeds):
        induce(seeds)
    out = []
    for c in range(256):
        # what the scan meets first in a bucket are the induced suffixes, which may induce more of the same bucket
        queue, met = induced[c], []
        while queue:
            run = np.concatenate(queue)
            met.append(run)
            induced[c] = queue = []
            induce(run)
            queue = induced[c]
        direct_here = kept[heads[c] : heads[c + 1]]
        if len(direct_here):
            met.append(direct_here)
            induce(direct_here)
        out += met
    array = np.concatenate(out) if out else np.empty(0, np.int64)
    return array[array <= np.repeat(last, ends - starts + 1)[array]]


def common_prefixes(raw: np.ndarray, array: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, ``most`` at most (0 for the first)."""
    out = np.zeros(len(array), dtype=np.int64)
    going = np.arange(1, len(array))
    for done in range(0, most, 8):
        if not len(going):
            break
        differ = words_at(raw, array[going] + done) ^ words_at(raw, array[going - 1] + done)
        odd = differ != 0
        shared = 8 - np.searchsorted(np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64), differ[odd], side="right")
        out[going[odd]] = np.minimum(done + shared, most)
        going = going[~odd]
    out[going] = most
    return out


def repeated_windows(parts: list[bytes], copies: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of windows, within each part, whose string occurs twice; a part counts ``copies`` times."""
    windows = np.array([len(p) for p in parts], dtype=np.int64) - length + 1
    ends = np.cumsum(windows + length) - 1
    starts = ends - windows - length + 1
    raw = np.frombuffer(b"\0".join([*parts, bytes(length + 16)]), dtype=np.uint8)
    array = suffix_array(raw, starts, ends, windows, length)
    group = np.cumsum(common_prefixes(raw, array, length) < length)
    owner = np.searchsorted(starts, array, side="right") - 1
    weight = np.bincount(group, weights=np.minimum(copies[owner], 2))
    found = np.zeros(len(raw) + 1, dtype=np.int8)
    found[array[weight[group] >= 2]] = 1
    edges = np.diff(found, prepend=0)
    opened, closed = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0) - 1
    owner = np.searchsorted(starts, opened, side="right") - 1
    return zip(owner.tolist(), (opened - starts[owner]).tolist(), (closed - starts[owner]).tolist())


# ---- parts of texts ----


def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return X.span_hashes(raw, starts, ends).view(np.int64)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the bytes of each run of ``gram`` bytes, by doubling."""
    out = X.mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER))
    size = 1
    while size < gram:
        by = min(size, gram - size)
        out = (out[:-by] * np.uint64(_MULTIPLIER)) + (out[by:] ^ (out[by:] >> np.uint64(29)))
        size += by
    return X.mix(out)


def parts_of(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The parts of the rows in flat bytes: row, at (from the row's start), n, anchor's place in the part, both hashes, and times.

    A part that follows an equal one without a gap (a long run of one byte or one short pattern) is counted in ``times``.
    """
    span = length - gram + 1
    if len(raw) < length:
        return {k: np.empty(0, np.int64) for k in ("row", "at", "n", "lead", "anchor", "content", "times")}
    hashes = gram_hashes(raw, gram)
    # the upper half orders, the place breaks ties towards the first
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < span:
        by = min(size, span - size)
        least = np.minimum(least[:-by], least[by:])
        size += by
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    room = np.zeros(len(place) + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(room, offsets[long], 1)
    np.add.at(room, offsets[long + 1] - length + 1, -1)
    whole = np.cumsum(room[:-1]) > 0
    edge = np.ones(len(place), dtype=bool)
    edge[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
    bounds = np.append(np.flatnonzero(edge), len(place))
    start, n = bounds[:-1], np.diff(bounds)
    start, n = start[whole[start]], n[whole[start]]
    anchor, content = hashes[place[start]].view(np.int64), _hash(raw, start, start + n + length - 1)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (content[1:] != content[:-1]) | (n[1:] != n[:-1]) | (start[1:] != start[:-1] + n[:-1])
    firsts = np.flatnonzero(new)
    times = np.diff(np.append(firsts, len(start)))
    row = np.searchsorted(offsets, start[firsts], side="right") - 1
    return {"row": row, "at": start[firsts] - offsets[row], "n": n[firsts], "lead": (place[start] - start)[firsts], "anchor": anchor[firsts], "content": content[firsts], "times": times}


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, their flat bytes, offsets, bytes before them): slices of a batch; a long text comes in pieces that overlap."""
    for rows in X.slices(batch, "text", PIECE):
        raw, offsets = X.flat(rows.column("text"))
        for begin in range(0, max(len(raw), 1), PIECE) if len(rows) == 1 else (0,):
            piece = raw[begin : begin + PIECE + LENGTH - 1] if len(rows) == 1 else raw
            yield rows, piece, np.array([0, len(piece)]) if len(rows) == 1 else offsets, begin


def parts(texts: DataFrame) -> DataFrame:
    """texts (k1, k2, text) -> the parts (anchor, content, k1, k2, at, n, lead, times) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets, begin in _pieces(batch):
                got = parts_of(raw, offsets)
                keys = [np.asarray(rows.column(k))[got["row"]] for k in ("k1", "k2")]
                small = [pa.array(got[k].astype(np.int32)) for k in ("n", "lead", "times")]
                yield pa.RecordBatch.from_arrays([pa.array(got["anchor"]), pa.array(got["content"]), *map(pa.array, keys), pa.array(got["at"] + begin), *small], ["anchor", "content", "k1", "k2", "at", "n", "lead", "times"])

    return texts.mapInArrow(run, "anchor long, content long, k1 long, k2 long, at long, n int, lead int, times int")


def fetched(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """wanted (anchor, content, copies, place: struct<k1, k2, at, n, lead>) with the bytes of each part, from the text that holds it."""
    listed = wanted.groupBy("place.k1", "place.k2").agg(F.collect_list(F.struct("anchor", "content", "copies", "place.at", "place.n", "place.lead")).alias("parts"))
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    each = once.join(listed, ["k1", "k2"]).select(F.col("text").cast("binary").alias("raw"), F.explode("parts").alias("p"))
    return each.select("p.anchor", "p.content", "p.copies", "p.lead", F.substring("raw", (F.col("p.at") + 1).cast("int"), F.col("p.n") + (LENGTH - 1)).alias("raw"))


def split(many: DataFrame, width: int) -> DataFrame:
    """Parts (anchor, content, copies, lead, raw), their windows dealt by the anchor's place, ``width`` places together.

    Returns (anchor, content, copies, lead, raw, of_anchor, of_content, shift): the new anchor stands for all bytes that windows of these
    places share, and the new part's windows are those of the old from ``shift`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(k).to_pylist() for k in ("anchor", "content", "copies", "lead", "raw")}
            out: list[tuple] = []
            for anchor, content, copies, lead, raw in zip(*columns.values()):
                n = len(raw) - LENGTH + 1
                # window j has the anchor at place lead - j; classes are counted from place 0
                for k in range((lead - n + 1) // width, lead // width + 1):
                    begin, stop = max(0, lead - (k + 1) * width + 1), min(n - 1, lead - k * width)
                    shared = raw[lead - k * width : lead - (k + 1) * width + 1 + LENGTH]
                    own = raw[begin : stop + LENGTH]
                    out.append((*(int.from_bytes(hashlib.blake2b(x, digest_size=8, key=bytes([width, k])).digest(), "little", signed=True) for x in (shared, own)), copies, lead - begin, own, anchor, content, begin))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()))], ["anchor", "content", "copies", "lead", "raw", "of_anchor", "of_content", "shift"])

    return many.select("anchor", "content", "copies", "lead", "raw").mapInArrow(run, "anchor long, content long, copies long, lead int, raw binary, of_anchor long, of_content long, shift int")


def searched(dealt: DataFrame) -> DataFrame:
    """dealt (anchor, content, copies, raw) -> (anchor, content, start, stop): runs of repeated windows, by suffix arrays."""

    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            got = list(repeated_windows(raws, np.array(copies, dtype=np.float64)))
            return pa.RecordBatch.from_arrays([pa.array([keys[p][0] for p, _, _ in got], pa.int64()), pa.array([keys[p][1] for p, _, _ in got], pa.int64()), pa.array([b for _, b, _ in got], pa.int32()), pa.array([e for _, _, e in got], pa.int32())], ["anchor", "content", "start", "stop"])

        keys, copies, raws, size = [], [], [], 0
        for batch in batches:
            for key, times, raw in zip(zip(batch.column("anchor").to_pylist(), batch.column("content").to_pylist()), batch.column("copies").to_pylist(), batch.column("raw").to_pylist()):
                if size >= most and key[0] != keys[-1][0]:
                    yield answer()
                    keys, copies, raws, size = [], [], [], 0
                keys.append(key)
                copies.append(times)
                raws.append(raw)
                size += len(raw) - LENGTH + 1
        if keys:
            yield answer()

    return dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, start int, stop int")


def repeats(known: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """known (anchor, content, copies, lead, raw), settled -> (anchor, content, start, stop): runs of repeated windows of each part."""
    crowded = known.groupBy("anchor").agg(F.count("*").alias("parts")).where(F.col("parts") > MANY).select("anchor") if widths else None
    if crowded is None or crowded.isEmpty():
        return searched(known.select("anchor", "content", "copies", "raw"))
    crowded = X.settled(crowded, "crowded")
    few = known.join(crowded, "anchor", "left_anti")
    pieces = X.settled(split(known.join(crowded, "anchor"), widths[0]), "pieces")
    again = X.settled(pieces.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.first("lead").alias("lead"), F.first("raw").alias("raw")), "smaller")
    found = repeats(again, widths[1:])
    back = pieces.select("anchor", "content", "of_anchor", "of_content", "shift").join(found, ["anchor", "content"])
    own = back.select(F.col("of_anchor").alias("anchor"), F.col("of_content").alias("content"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"))
    return searched(few.select("anchor", "content", "copies", "raw")).unionByName(own)


# ---- documents ----


def without(texts: DataFrame) -> DataFrame:
    """texts (key, text, spans: array<struct<from, to>> of bytes, in any order) -> (key, n_bytes, n_removed, n_spans, kept)."""
    schema = texts.select("key").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in X.slices(batch, "text"):
                out: list[tuple] = []
                for text, spans in zip(rows.column("text"), rows.column("spans")):
                    raw = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                    cover = np.zeros(len(raw) + 1, dtype=np.int32)
                    if spans.is_valid:
                        begin, end = (np.asarray(spans.values.field(k)) for k in (0, 1))
                        np.add.at(cover, begin, 1)
                        np.add.at(cover, end, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    out.append((len(raw), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])), raw[~gone].tobytes()))
                n, removed, runs, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], schema.names)

    return texts.select("key", "text", "spans").mapInArrow(run, schema)


def covered(texts: DataFrame) -> DataFrame:
    """texts (k1, k2, text), equal keys for equal texts -> (k1, k2, spans): the bytes that repeated strings cover."""
    spark, folder = texts.sparkSession, X.shared_dir(texts.sparkSession)

    def done(name: str) -> None:
        """What nothing reads any more goes: a table, and the shuffle files of finished steps."""
        X.dropped(spark, f"{folder}/{name}")
        X.release(spark)

    cut = X.stored(parts(texts.where(F.octet_length("text") >= LENGTH)), f"{folder}/parts")
    twice = cut.groupBy("anchor").agg(F.sum("times").alias("all")).where(F.col("all") >= 2).select("anchor")
    found = X.stored(cut.join(twice, "anchor", "left_semi"), f"{folder}/shared")
    done("parts")
    place = F.struct("k1", "k2", "at", "n", "lead")
    unlike = found.groupBy("anchor", "content").agg(F.sum("times").alias("copies"), F.min(place).alias("place"))
    known = X.stored(fetched(unlike, texts), f"{folder}/known")
    X.release(spark)
    runs = X.stored(repeats(known), f"{folder}/repeats")
    done("known")
    places = found.join(runs, ["anchor", "content"]).select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("i"), "at", "n", "start", "stop")
    begin = F.col("at") + F.col("i") * F.col("n")
    spans = places.select("k1", "k2", (begin + F.col("start")).alias("from"), (begin + F.col("stop") + LENGTH).alias("to")).distinct()
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def remove(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept: binary) of every row: the text without bytes of strings that occur twice."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2"))
    spans = covered(rows.select("k1", "k2", "text"))
    return without(rows.join(spans, ["k1", "k2"], "left")).withColumnRenamed("key", key)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    with X.batches_of(df.sparkSession, BATCH):
        return X.settled(remove(df, key, text).select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "removed")
