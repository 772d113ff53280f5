"""Media columns: whole texts as progressive JPEG files, read back as coefficients and RGB tensors.

A text's UTF-8 bytes and zero bytes up to a positive multiple of 64 are its payload.  Every 64 bytes
are one 8 x 8 block's coefficients in zigzag order, the format's own unit, which its scans keep
without loss (samples would be rounded by the transform).  The file holds them as a grey image of one
quantiser, at most ``ACROSS`` blocks wide (wider if it would be over ``DOWN`` blocks high), in six scans of spectral selection and successive
approximation; a comment holds the payload's length, as the last row of blocks may be filled up.
Reading accumulates the scans into coefficients, transforms them to samples and repeats grey (or
chroma, in other files) to a full RGB tensor, whose shape, mean and checksum are the feature.

Defined results: null counts as empty (one block of zeros); equal texts give equal files and
features; texts are stored whole (one row holds at most the format's 65,535 x 65,535 samples); extra
columns are kept by ``store``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import jpeg
from lodestone.llm import text as X

#: columns of blocks, and the most rows of blocks that the format's 16 bits of height hold
ACROSS, DOWN = 64, 65_535 // 8
#: bytes of text or of files that are coded in step
STEP_BYTES = 1 << 19


def _files(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored file of every row of a flat column."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-sizes // 64))
    columns = np.maximum(np.minimum(blocks, ACROSS), -(-blocks // DOWN))
    rows = -(-blocks // columns)
    first = np.concatenate([[0], np.cumsum(rows * columns)])
    c = np.zeros(first[-1] * 64, dtype=np.uint8)
    c[np.arange(len(raw)) + np.repeat(first[:-1] * 64 - offsets[:-1], sizes)] = raw
    shapes = list(zip((rows * 8).tolist(), (columns * 8).tolist(), strict=True))
    return jpeg.encode([(c.reshape(-1, 64), first)], shapes, [str(int(b) * 64).encode() for b in blocks])


def _read(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB tensor) of files that ``_files`` made."""
    parsed = [jpeg.parse(f) for f in files]
    (c, first), = jpeg.coefficients(parsed)
    pixels = jpeg.samples(c, parsed[0].quantisers[0])
    flat = c.astype(np.uint8)
    out = []
    for i, p in enumerate(parsed):
        a, b = first[i], first[i + 1]
        out.append((flat[a:b].tobytes()[: int(p.note)], jpeg.tensor(p, [pixels[a:b]])))
    return out


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with the stored files in place of the texts, and the texts' lengths in bytes as ``n_bytes``."""
    keep = [c for c in df.columns if c not in (text, media, "n_bytes")]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, text, STEP_BYTES):
                raw, offsets = X.flat(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(offsets)), pa.array(_files(raw, offsets), pa.binary())], [*keep, "n_bytes", media])

    return df.select(*keep, text).mapInArrow(run, schema)


def tensors(df: DataFrame, media: str = "media") -> DataFrame:
    """df with (height, width, rgb) of any progressive JPEG files in place of the media column."""
    keep = [c for c in df.columns if c not in (media, "height", "width", "rgb")]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, media, STEP_BYTES):
                blobs = part.column(media).to_pylist()
                found = dict(zip((i for i, b in enumerate(blobs) if b), jpeg.decode([b for b in blobs if b]), strict=True))
                shape = [found[i].shape if i in found else (None, None) for i in range(len(blobs))]
                rgb = [found[i].tobytes() if i in found else None for i in range(len(blobs))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([s[0] for s in shape], pa.int32()), pa.array([s[1] for s in shape], pa.int32()), pa.array(rgb, pa.binary())], [*keep, "height", "width", "rgb"])

    return df.select(*keep, media).mapInArrow(run, schema)


def features(stored: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What the stored bytes of ``store`` give when read back, one row each."""
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([stored.schema[key], *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, media, STEP_BYTES):
                blobs = part.column(media).to_pylist()
                rows = []
                for blob, (payload, rgb) in zip(blobs, _read(blobs), strict=True):
                    total = int(rgb[:, :, 0].sum(dtype=np.int64))
                    feature = f"{rgb.shape[0]}x{rgb.shape[1]} mean {1000 * total // rgb[:, :, 0].size} crc {zlib.crc32(rgb.tobytes()):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return stored.select(key, "n_bytes", media).mapInArrow(run, schema)
