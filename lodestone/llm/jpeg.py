"""Progressive JPEG on numpy arrays: coefficient arrays in and out of scans, and pixels out of coefficients.

Both directions work on many images of one structure at once.  A *lane* is one restart interval; all
lanes of all images are coded in step, one symbol each at a time, so the cost of an array operation
is shared by thousands of blocks.  Images without restart intervals are one lane each.

Coefficients are (blocks, 64) in zigzag order.  Scans are (components, first, last, high, low) as in
the scan header: spectral selection by first and last, successive approximation by high and low.
The encoder writes a restart interval, end-of-band runs of one block, and one fixed pair of Huffman
tables; the decoder reads any tables, end-of-band runs, interleaving and sampling factors.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The zigzag order of an 8 x 8 block, as row-major positions.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
#: successive approximation in two steps for AC and one for DC, AC in two spectral bands first
SCANS = (((0,), 0, 0, 0, 1), ((0,), 1, 15, 0, 2), ((0,), 16, 63, 0, 2), ((0,), 1, 63, 2, 1), ((0,), 0, 0, 1, 0), ((0,), 1, 63, 1, 0))
#: blocks of a restart interval that the encoder writes
INTERVAL = 4
_EOB, _ZRL = 0x00, 0xF0


def _canonical(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol, of a table given as the count of each length 1 .. 16 and the symbols in order."""
    code, at = 0, 0
    codes, sizes = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[symbols[at]], sizes[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return codes, sizes


def _lookup(lengths: list[int], symbols: list[int]) -> np.ndarray:
    """symbol * 32 + length for every 16 bits that may come next."""
    codes, sizes = _canonical(lengths, symbols)
    table = np.zeros(1 << 16, dtype=np.int64)
    for s in symbols:
        n = int(sizes[s])
        start = int(codes[s]) << (16 - n)
        table[start : start + (1 << (16 - n))] = s * 32 + n
    return table


DC_SYMBOLS = list(range(12))
DC_LENGTHS = [0, 0, 0, 12] + [0] * 12
_SHORT = [0x05, 0x04, 0x06]
AC_SYMBOLS = _SHORT + [s for s in [_EOB, _ZRL, *(r * 16 + s for r in range(16) for s in range(1, 11))] if s not in _SHORT]
AC_LENGTHS = [1, 1, 1] + [0] * 7 + [len(AC_SYMBOLS) - 3] + [0] * 5
_DC, _AC = _canonical(DC_LENGTHS, DC_SYMBOLS), _canonical(AC_LENGTHS, AC_SYMBOLS)


_LENGTHS = np.array([i.bit_length() for i in range(1 << 12)], dtype=np.int64)
#: event and size of a positive coefficient that follows another
_NEXT = np.array([(int(_AC[0][n]) << n | i) if (n := i.bit_length()) in range(1, 11) else 0 for i in range(1 << 10)], dtype=np.uint32)
_NEXT_BITS = np.array([int(_AC[1][n]) + n if (n := i.bit_length()) in range(1, 11) else 0 for i in range(1 << 10)], dtype=np.int64)


def _bit_length(x: np.ndarray) -> np.ndarray:
    return _LENGTHS[x]


def _paired(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grids of the same bits in fewer events: neighbours become one while both surely fit into 32 bits."""
    while value.shape[1] > 1 and int(size.max(initial=0)) <= 16:
        if value.shape[1] % 2:
            value, size = (np.hstack([x, np.zeros((len(x), 1), x.dtype)]) for x in (value, size))
        value = (value[:, ::2] << size[:, 1::2].astype(value.dtype)) | value[:, 1::2]
        size = size[:, ::2] + size[:, 1::2]
    return value, size


def _pack(value: np.ndarray, size: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each interval plus the total); value and size are flat events in order, of at most 32 bits."""
    n = int(interval[-1]) + 1 if len(interval) else 0
    used = size > 0
    value, size, owner = value[used].astype(np.uint64), size[used], interval[used]
    ends = np.cumsum(size)
    last = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(n), side="right")]
    bits = np.diff(np.concatenate([[0], last]))
    pad = -bits % 8
    first = np.concatenate([[0], np.cumsum((bits + pad) // 8)])
    # where every event's bits begin, once its interval begins on a byte
    begin = ends - size + np.repeat(first[:-1] * 8 - (last - bits), np.bincount(owner, minlength=n))
    stop = first[1:] * 8 - pad
    filler = pad > 0
    begin, size = np.concatenate([begin, stop[filler]]), np.concatenate([size, pad[filler]])
    value = np.concatenate([value, ((1 << pad[filler]) - 1).astype(np.uint64)])
    # an event reaches into two words of 32 bits at most; no two events share a bit, so sums put them together
    word = begin >> 5
    wide = value << (64 - (begin & 31) - size).astype(np.uint64)
    words = int(first[-1]) // 4 + 2
    total = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return total.astype(np.uint32).astype(">u4").view(np.uint8)[: first[-1]], first


def _with_markers(data: np.ndarray, first: np.ndarray, turn: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-stuffed intervals, each but the last of its scan followed by a restart marker."""
    width = 1 + (data == 0xFF)
    place = np.concatenate([[0], np.cumsum(width)])
    start = place[first] + np.concatenate([[0], np.cumsum(np.where(last, 0, 2))])
    out = np.zeros(start[-1], dtype=np.uint8)
    shift = np.repeat(start[:-1] - place[first[:-1]], np.diff(first))
    out[place[:-1] + shift] = data
    end = start[1:][~last]
    out[end - 2], out[end - 1] = 0xFF, 0xD0 + turn[~last] % 8
    return out, start


def _scan_events(c: np.ndarray, scan: tuple, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, size) of a scan's events as (blocks, events) grids; fresh: blocks that open an interval."""
    _, first, last, high, low = scan
    if first == 0:
        v = c[:, 0] >> low
        if high:
            return (v & 1)[:, None].astype(np.uint32), np.ones((len(c), 1), np.int64)
        diff = v - np.where(fresh, 0, np.concatenate([[0], v[:-1]]))
        n = _bit_length(np.abs(diff))
        extra = np.where(diff < 0, diff + (1 << n) - 1, diff)
        return ((_DC[0][n].astype(np.int64) << n) | extra)[:, None].astype(np.uint32), (_DC[1][n] + n)[:, None]
    band = c[:, first : last + 1]
    if high:
        return _refined(band, high, low)
    plain = ((band >> low) > 0).all(axis=1)
    if plain.any():
        value, bits = np.zeros((len(c), band.shape[1] + 1), np.uint32), np.zeros((len(c), band.shape[1] + 1), np.int64)
        upper = band[plain] >> low
        value[plain, :-1], bits[plain, :-1] = _NEXT[upper], _NEXT_BITS[upper]
        if not plain.all():
            v, n = _scan_events(c[~plain], scan, fresh[~plain])
            if v.shape[1] > value.shape[1]:
                value, bits = (np.hstack([x, np.zeros((len(c), v.shape[1] - x.shape[1]), x.dtype)]) for x in (value, bits))
            value[~plain], bits[~plain] = v, n
        return value, bits
    size = np.abs(band) >> low
    there = size > 0
    at = np.arange(band.shape[1])
    before = np.maximum.accumulate(np.where(there, at, -1), axis=1)
    last_there = before[:, -1]
    before = np.concatenate([np.full((len(c), 1), -1), before[:, :-1]], axis=1)
    run = np.where(there, at - before - 1, 0)
    n = _bit_length(size)
    symbol = (run % 16) * 16 + n
    extra = np.where(band < 0, (1 << n) - 1 - size, size)
    value = np.where(there, (_AC[0][symbol].astype(np.int64) << n) | extra, 0)
    bits = np.where(there, _AC[1][symbol] + n, 0)
    if (skip := run // 16).any():
        wide = np.stack([np.where(skip > i, int(_AC[0][_ZRL]), 0) for i in range(3)] + [value], axis=2)
        value, bits = wide.reshape(len(c), -1), np.stack([np.where(skip > i, int(_AC[1][_ZRL]), 0) for i in range(3)] + [bits], axis=2).reshape(len(c), -1)
    open_ = (last_there < band.shape[1] - 1)[:, None]
    return np.hstack([value, np.where(open_, int(_AC[0][_EOB]), 0)]).astype(np.uint32), np.hstack([bits, np.where(open_, int(_AC[1][_EOB]), 0)])


def _refined(band: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.abs(band)
    old = (size >> high) > 0
    new = ~old & ((size >> low) == 1)
    value = np.hstack([np.full((len(band), 1), int(_AC[0][_EOB])), (size >> low) & 1])
    bits = np.hstack([np.full((len(band), 1), int(_AC[1][_EOB])), old.astype(np.int64)])
    rare = np.flatnonzero(new.any(axis=1))
    if not len(rare):
        return value.astype(np.uint32), bits
    # blocks with coefficients that are new at this step: symbol by symbol
    rows = {}
    for b in rare:
        out, waiting, run = [], [], 0
        left = int(new[b].sum())
        for k in range(band.shape[1]):
            if old[b, k] or new[b, k]:
                while run > 15 and left:
                    out += [(int(_AC[0][_ZRL]), int(_AC[1][_ZRL])), *waiting]
                    waiting, run = [], run - 16
            if old[b, k]:
                waiting.append((int(size[b, k] >> low) & 1, 1))
            elif new[b, k]:
                s = run * 16 + 1
                out += [(int(_AC[0][s]), int(_AC[1][s])), (int(band[b, k] > 0), 1), *waiting]
                waiting, run, left = [], 0, left - 1
            else:
                run += 1
        if waiting or run:
            out += [(int(_AC[0][_EOB]), int(_AC[1][_EOB])), *waiting]
        rows[b] = out
    more = max(map(len, rows.values())) - value.shape[1]
    if more > 0:
        value, bits = (np.hstack([x, np.zeros((len(band), more), x.dtype)]) for x in (value, bits))
    for b, out in rows.items():
        value[b], bits[b] = 0, 0
        value[b, : len(out)], bits[b, : len(out)] = zip(*out, strict=True)
    return value.astype(np.uint32), bits


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind, *lengths, *symbols]))


def encode(planes: list[tuple[np.ndarray, np.ndarray]], shapes: list[tuple[int, int]], notes: list[bytes] | None = None, sampling: tuple = ((1, 1),), scans: tuple = SCANS, quantiser: int = 1) -> list[bytes]:
    """Progressive JPEG files of a batch of images.

    planes: for each component (coefficients of all images one after another, first block of each image
    plus the total), in the component's raster order; with several components every scan has one.
    shapes: (height, width) in pixels; notes: a comment for each file.
    """
    n = len(shapes)
    tables = _segment(0xDB, bytes([0] + [quantiser] * 64))
    tables += _dht(0x00, DC_LENGTHS, DC_SYMBOLS) + _dht(0x10, AC_LENGTHS, AC_SYMBOLS) + _segment(0xDD, struct.pack(">H", INTERVAL))
    parts: list[list[bytes]] = []
    for i, (height, width) in enumerate(shapes):
        frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([k + 1, h * 16 + v, 0]) for k, (h, v) in enumerate(sampling))
        parts.append([b"\xff\xd8", _segment(0xFE, notes[i]) if notes else b"", tables, _segment(0xC2, frame)])
    for scan in scans:
        (component,) = scan[0]
        c, first = planes[component]
        counts = np.diff(first)
        place = np.arange(len(c)) - np.repeat(first[:-1], counts)
        fresh = place % INTERVAL == 0
        value, bits = _paired(*_scan_events(c.astype(np.int32), scan, fresh))
        interval = np.repeat(np.cumsum(fresh) - 1, value.shape[1])
        data, at = _pack(value.ravel(), bits.ravel(), interval)
        turn = place[fresh] // INTERVAL
        last = place[fresh] + INTERVAL >= np.repeat(counts, counts)[fresh]
        stream, start = _with_markers(data, at, turn, last)
        edge = start[np.concatenate([[0], np.cumsum(-(-counts // INTERVAL))])]
        header = _segment(0xDA, bytes([1, component + 1, 0x00, scan[1], scan[2], scan[3] * 16 + scan[4]]))
        blob = stream.tobytes()
        for i in range(n):
            parts[i] += [header, blob[edge[i] : edge[i + 1]]]
    return [b"".join(p) + b"\xff\xd9" for p in parts]


@dataclass
class Parsed:
    """The segments of one file; ``kind`` is equal for files that can be decoded together."""

    height: int = 0
    width: int = 0
    note: bytes = b""
    components: tuple = ()
    quantisers: dict = field(default_factory=dict)
    scans: list = field(default_factory=list)
    kind: tuple = ()


def parse(blob: bytes) -> Parsed:
    out, at, interval, tables = Parsed(), 2, 0, {}
    if blob[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    kinds: list = []
    while at + 4 <= len(blob):
        if blob[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", blob, at + 2)[0]
        body = blob[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            out.note = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                width = 128 if wide else 64
                out.quantisers[body[0] & 15] = tuple(struct.unpack(">64H" if wide else ">64B", body[1 : 1 + width]))
                body = body[1 + width :]
        elif marker == 0xC4:
            while body:
                lengths = tuple(body[1:17])
                n = sum(lengths)
                tables[body[0]] = (lengths, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = tuple((body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n))
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not progressive")
        elif marker == 0xDA:
            n = body[0]
            ids = [c[0] for c in out.components]
            used = tuple((ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            end = at
            while True:
                end = blob.find(b"\xff", end)
                if end < 0 or end + 1 >= len(blob):
                    end = len(blob)
                    break
                if blob[end + 1] == 0 or 0xD0 <= blob[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            named = tuple((k, tables.get(dc), tables.get(16 + ac)) for k, dc, ac in used)
            kinds.append((named, first, last, approx >> 4, approx & 15, interval))
            out.scans.append(blob[at:end])
            at = end
    out.kind = (out.components, tuple(sorted(out.quantisers.items())), tuple(kinds))
    return out


def _lanes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit big-endian word at every byte, first bit of each lane, lanes of each stream), stuffing taken out."""
    raw = np.frombuffer(b"\xff\xd0".join(streams) + b"\xff\xd0", np.uint8)
    mark = np.zeros(len(raw), dtype=bool)
    mark[:-1] = (raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
    stuffed = np.zeros(len(raw), dtype=bool)
    stuffed[1:] = (raw[:-1] == 0xFF) & (raw[1:] == 0)
    drop = mark | stuffed
    drop[1:] |= mark[:-1]
    kept = raw[~drop]
    marks = np.flatnonzero(mark)
    upto = np.cumsum(~drop)
    starts = np.concatenate([[0], upto[marks][:-1]])
    sizes = np.cumsum([len(s) + 2 for s in streams])
    lanes = np.diff(np.concatenate([[0], np.searchsorted(marks, sizes)]))
    b = np.concatenate([kept, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    return word.astype(np.int64), starts * 8, lanes


class _Reader:
    def __init__(self, word: np.ndarray, bit: np.ndarray):
        self.word, self.bit, self.most = word, bit, len(word) - 1

    def symbol(self, lane: np.ndarray, table: np.ndarray) -> np.ndarray:
        p = self.bit[lane]
        found = table[(self.word[np.minimum(p >> 3, self.most)] >> (16 - (p & 7))) & 0xFFFF]
        if not (found & 31).all():
            raise ValueError("an unknown code")
        self.bit[lane] = p + (found & 31)
        return found >> 5

    def bits(self, lane: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.bit[lane]
        self.bit[lane] = p + n
        return (self.word[np.minimum(p >> 3, self.most)] >> (32 - (p & 7) - n)) & ((1 << n) - 1)

    def bit_at(self, p: np.ndarray) -> np.ndarray:
        return (self.word[np.minimum(p >> 3, self.most)] >> (31 - (p & 7))) & 1


def _signed(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _refine(r: _Reader, c: np.ndarray, lane: np.ndarray, block: np.ndarray, k: np.ndarray, zeros: np.ndarray | None, last: int, low: int) -> np.ndarray:
    """Corrects what is not zero from k up to the zero number ``zeros`` (from 0) or past ``last``; returns that place."""
    at = np.arange(c.shape[1], dtype=np.int16)
    band = c[block]
    fix = band != 0
    fix &= (at >= k.astype(np.int16)[:, None]) & (at <= last)
    end = np.full(len(block), last + 1)
    if zeros is not None:
        blank = (at >= k.astype(np.int16)[:, None]) & (at <= last) & (band == 0)
        stop = blank & (np.cumsum(blank, axis=1, dtype=np.int16) == (zeros + 1).astype(np.int16)[:, None])
        end = np.where(stop.any(axis=1), stop.argmax(axis=1), end)
        fix &= at < end.astype(np.int16)[:, None]
    n = fix.sum(axis=1)
    many = int(n.sum())
    # the bits of a lane stand one after another, in the order of its coefficients
    bit = r.bit_at(np.arange(many) + np.repeat(r.bit[lane] - (np.cumsum(n) - n), n))
    old = band[fix]
    band[fix] = old + np.sign(old) * (bit << low).astype(c.dtype)
    c[block] = band
    r.bit[lane] += n
    return end


def _scan(c: np.ndarray, r: _Reader, order: np.ndarray, of: np.ndarray, scan: tuple, tables: list) -> None:
    """One scan of all lanes; order: (lanes, places) block numbers or -1; of: the component of each place."""
    _, first, last, high, low, _ = scan
    runs = np.zeros(len(order), dtype=np.int64)
    before = np.zeros((len(order), int(of.max()) + 1), dtype=np.int64)
    for j in range(order.shape[1]):
        lane = np.flatnonzero(order[:, j] >= 0)
        block = order[lane, j]
        dc, ac = tables[of[j]]
        if first == 0:
            if high:
                c[block, 0] |= (r.bits(lane, np.ones(len(lane), np.int64)) << low).astype(c.dtype)
            else:
                n = r.symbol(lane, dc)
                before[lane, of[j]] += _signed(r.bits(lane, n), n)
                c[block, 0] = before[lane, of[j]] << low
            continue
        waiting = runs[lane] > 0
        if high and waiting.any():
            some = lane[waiting]
            _refine(r, c, some, block[waiting], np.full(len(some), first), None, last, low)
        runs[lane[waiting]] -= 1
        lane, block = lane[~waiting], block[~waiting]
        k = np.full(len(lane), first)
        while len(lane):
            s = r.symbol(lane, ac)
            run, n = s >> 4, s & 15
            end = (n == 0) & (run < 15)
            if end.any():
                more = run[end]
                runs[lane[end]] = (1 << more) - 1 + r.bits(lane[end], more)
                if high:
                    _refine(r, c, lane[end], block[end], k[end], None, last, low)
                on = ~end
                lane, block, k, run, n = lane[on], block[on], k[on], run[on], n[on]
            if not len(lane):
                break
            if high:
                new = np.zeros(len(lane), np.int64)
                put = n > 0
                new[put] = np.where(r.bits(lane[put], np.ones(int(put.sum()), np.int64)) > 0, 1 << low, -(1 << low))
                k = _refine(r, c, lane, block, k, run, last, low)
                c[block[put], k[put]] = new[put]
            else:
                k = k + run
                put = n > 0
                v = _signed(r.bits(lane, n), n) << low if low == 0 else np.sign(w := _signed(r.bits(lane, n), n)) * (np.abs(w) << low)
                c[block[put], k[put]] = v[put]
            k = k + 1
            on = k <= last
            lane, block, k = lane[on], block[on], k[on]


def _grid(p: Parsed, component: int) -> tuple[int, int, int, int]:
    """Blocks of a component: (rows, columns) stored, whole MCUs, and (rows, columns) that a scan of its own codes."""
    h_most, v_most = max(c[1] for c in p.components), max(c[2] for c in p.components)
    _, h, v, _ = p.components[component]
    across, down = -(-p.width // (8 * h_most)), -(-p.height // (8 * v_most))
    own = (-(-(-(-p.height * v // v_most)) // 8), -(-(-(-p.width * h // h_most)) // 8))
    return down * v, across * h, *own


def coefficients(files: list[Parsed]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component (coefficients of all files one after another, first block of each plus the total)."""
    kind = files[0].kind
    components, _, scans = kind
    first, total = [], 0
    for k in range(len(components)):
        sizes = [g[0] * g[1] for g in (_grid(p, k) for p in files)]
        first.append(total + np.concatenate([[0], np.cumsum(sizes)]))
        total = int(first[-1][-1])
    c = np.zeros((total, 64), dtype=np.int16)
    for n, scan in enumerate(scans):
        named, interval = scan[0], scan[5]
        tables = [(_lookup(*dc) if dc else None, _lookup(*ac) if ac else None) for _, dc, ac in named]
        orders = []
        for i, p in enumerate(files):
            if len(named) == 1:
                k = named[0][0]
                _, columns, own_rows, own_columns = _grid(p, k)
                seq = (first[k][i] + np.arange(own_rows)[:, None] * columns + np.arange(own_columns)).reshape(-1, 1)
            else:
                parts = []
                for k, _, _ in named:
                    _, h, v, _ = components[k]
                    rows, columns, _, _ = _grid(p, k)
                    parts.append((first[k][i] + np.arange(rows * columns)).reshape(rows // v, v, columns // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
                seq = np.hstack(parts)
            step = interval or len(seq)
            short = -len(seq) % step
            orders.append(np.vstack([seq, np.full((short, seq.shape[1]), -1)]).reshape(-1, step * seq.shape[1]))
        wide = max(o.shape[1] for o in orders)
        order = np.vstack([np.pad(o, ((0, 0), (0, wide - o.shape[1])), constant_values=-1) for o in orders])
        per = [1] if len(named) == 1 else [components[k][1] * components[k][2] for k, _, _ in named]
        of = np.tile(np.repeat(np.arange(len(named)), per), wide // sum(per))
        word, start, lanes = _lanes([p.scans[n] for p in files])
        if not np.array_equal(lanes, [len(o) for o in orders]):
            raise ValueError("restart markers are missing")
        _scan(c, _Reader(word, start), order, of, scan, tables)
    return [(c[f[0] : f[-1]], f - f[0]) for f in first]


_SCALE = 1 << 13
_BASIS = np.round(np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)]) * _SCALE)


def samples(c: np.ndarray, quantiser: tuple) -> np.ndarray:
    """(blocks, 8, 8) samples of 8 bits: an inverse transform in whole numbers, so that every machine agrees."""
    out = np.empty((len(c), 8, 8), dtype=np.uint8)
    q = np.array(quantiser, dtype=np.float64)
    # products and sums stay whole numbers under 2 ** 53, so the order in which they are added does not matter
    for a in range(0, len(c), 4096):
        block = np.zeros((len(c[a : a + 4096]), 64))
        block[:, ZIGZAG] = np.clip(c[a : a + 4096].astype(np.float64) * q, -(1 << 15), 1 << 15)
        x = _BASIS @ (block.reshape(-1, 8) @ _BASIS.T).reshape(-1, 8, 8)
        out[a : a + 4096] = np.clip(np.floor((x + _SCALE * _SCALE // 2) / (_SCALE * _SCALE)) + 128, 0, 255)
    return out


def tensor(p: Parsed, planes: list[np.ndarray]) -> np.ndarray:
    """(height, width, 3) RGB of one file from its components' sample blocks; chroma is repeated to full size."""
    h_most, v_most = max(c[1] for c in p.components), max(c[2] for c in p.components)
    full = []
    for k, blocks in enumerate(planes):
        rows, columns, _, _ = _grid(p, k)
        plane = blocks.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        _, h, v, _ = p.components[k]
        full.append(plane.repeat(v_most // v, 0).repeat(h_most // h, 1)[: p.height, : p.width])
    if len(full) < 3:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y, cb, cr = (x.astype(np.int64) for x in full[:3])
    cb, cr = cb - 128, cr - 128
    half = 1 << 15
    rgb = [y + ((91881 * cr + half) >> 16), y - ((22554 * cb + 46802 * cr + half) >> 16), y + ((116130 * cb + half) >> 16)]
    return np.clip(np.stack(rgb, axis=2), 0, 255).astype(np.uint8)


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The RGB tensors of progressive JPEG files; files of one structure are decoded together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(parsed):
        groups.setdefault(p.kind, []).append(i)
    out: list[np.ndarray] = [np.empty(0)] * len(files)
    for (components, quantisers, _), at in groups.items():
        mine = [parsed[i] for i in at]
        planes = [(samples(c, dict(quantisers)[components[k][3]]), first) for k, (c, first) in enumerate(coefficients(mine))]
        for j, i in enumerate(at):
            out[i] = tensor(mine[j], [s[f[j] : f[j + 1]] for s, f in planes])
    return out
