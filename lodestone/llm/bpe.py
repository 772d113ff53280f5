"""Byte-level BPE, encoded by backtracking over longest token matches and decoded by an offset table.

Each pre-token is encoded on its own.  An Aho-Corasick automaton over all tokens reports, in one
scan, the longest token that starts at every byte.  Tokens are then taken greedily; a token may
follow another only if the pair is *compatible*, that is, if merging the two tokens' bytes gives
exactly those two tokens.  Where no token fits, the encoder drops its last token, marks that place
as dead and goes on with the next shorter token there.  A sequence whose neighbours are all
compatible is the one that applying the merges by rank would give, so the result is exact, and each
place is visited a bounded number of times.

Defined results: null and empty texts give no tokens and decode to the empty text; rows repeat as
they come; further columns of the input are kept by ``encode`` and ``decode``; texts of any length
are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import text as X

#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ROWS = 300_000
LONG_WORD = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(shifted)) for b in range(256)]


class Codec:
    """One vocabulary file of the ``tokenizers`` library, read into lookup tables."""

    def __init__(self, content: str):
        spec = json.loads(content)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        spelled = {t: i for t, i in vocab.items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in spelled.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.id_of = {self.bytes_of[i]: i for i in spelled.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at = [-1] * size
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            self.rank[pair] = n
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = pair, n
        # a byte string is a usable token only if its own merges lead to it
        self.automaton = ahocorasick.Automaton()
        for i in spelled.values():
            if len(self.bytes_of[i]) == 1 or i in self.parts:
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = [len(b) for b in self.bytes_of]
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.size = size
        self.cache: dict[str, tuple[int, ...]] = {}
        self.offset = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(b) for b in self.bytes_of], out=self.offset[1:])
        self.table = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.split = regex.compile(PATTERN).findall

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece, rank at which it is swallowed) of the pieces at one edge, from single byte to whole token."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.made_at[token]
            token = self.parts[token][side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge by rank ever crosses the border between tokens a and b (kept in a table)."""
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._border_holds(self._spine(a, 1), self._spine(b, 0))
        return known

    def _border_holds(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            merge = self.rank.get((x, y), 1 << 61)
            # equal ranks are the same pair: it is applied from left to right
            if merge < x_until and merge <= y_until:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def next_shorter(self, token: int) -> int:
        """The longest usable token that is a proper prefix of the token; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            whole, found = self.bytes_of[token], -1
            for n in range(len(whole) - 1, 0, -1):
                i = self.id_of.get(whole[:n])
                if i is not None and (n == 1 or i in self.parts):
                    found = i
                    break
            self.shorter[token] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.id_of.get(word)
        n = len(word)
        longest = [-1] * n
        length = self.length
        for end, token in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[token] > length[longest[start]]:
                longest[start] = token
        if whole is not None and longest[0] == whole and self._whole_is_stable(whole):
            return [whole]
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            while token >= 0 and not (alive[place + length[token]] and (not out or self.compatible(out[-1], token))):
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                place += length[token]
                token = longest[place] if place < n else -1
            else:
                alive[place] = 0
                last = out.pop()
                place -= length[last]
                token = self.next_shorter(last)
        return out

    def _whole_is_stable(self, token: int) -> bool:
        return token not in self.parts or self.compatible(*self.parts[token]) is False

    def _ids(self, piece: str) -> list[int]:
        cache = self.cache
        found = self.split(piece)
        try:
            return list(chain.from_iterable(map(cache.__getitem__, found)))
        except KeyError:
            out: list[int] = []
            for w in found:
                ids = cache.get(w)
                if ids is None:
                    ids = tuple(self.encode_word(w.encode()))
                    if len(w) <= LONG_WORD:
                        if len(cache) >= CACHE_ROWS:
                            cache.clear()
                        cache[w] = ids
                out.extend(ids)
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            return out

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text; the vocabulary's special strings are one token each."""
        if self.specials is None or not self.specials.search(text):
            return np.array(self._ids(text), dtype=np.uint32)
        out: list[int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self._ids(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return np.array(out + self._ids(text[at:]), dtype=np.uint32)

    def encode_plain(self, text: str) -> np.ndarray:
        """Token ids of a whole text in which special strings are plain text."""
        return np.array(self._ids(text), dtype=np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """All tokens' bytes, gathered from the table through its offsets."""
        ids = np.asarray(ids, dtype=np.int64)
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        return self.table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Read once per Python worker; the path is one that every executor has (an installed package's file)."""
    with open(path, encoding="utf-8") as f:
        return Codec(f.read())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids (array<int>); an ``ids`` column of df is replaced."""
    keep = [c for c in df.columns if c != ids]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in X.slices(batch, text):
                got = [c.encode(t or "") for t in part.column(text).to_pylist()]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, got)]).astype(np.int32), np.concatenate([*got, np.empty(0, np.uint32)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], [*keep, ids])

    return df.select(*keep).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of token ids; a ``text`` column of that name is replaced."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            got = [c.decode(np.array(v, dtype=np.int64)) if v else "" for v in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(got, pa.string())], [*keep, text])

    return df.select(*keep).mapInArrow(run, schema)


def digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns (key, n_tokens, ids_sha256, decoded_sha256)."""
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for t in batch.column(text):
                ids = c.encode(t.as_py() or "")
                back = c.decode_bytes(ids).tobytes()
                try:
                    back.decode("utf-8")
                except UnicodeDecodeError:
                    back = back.decode("utf-8", "replace").encode()
                counts.append(len(ids))
                of_ids.append(sha(ids.astype("<u4").tobytes()))
                of_text.append(sha(back))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, schema)
