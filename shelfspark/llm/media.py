"""Media columns: texts as PNG images in a binary column, and perceptual hashes of images.

The PNG files are written and read with zlib and numpy only: chunks with their checksums,
the five row filters, and a hash of the lowest frequencies of a two-dimensional cosine
transform, itself a binary column. ``store`` writes the images; ``read`` takes what is stored.

Defined results: a null text counts as empty; an empty text gives a payload of one row of
spaces; equal texts give equal files and features; very long texts make tall images of
any height; a frequency equal to the median is no bit; repeated rows, null or equal ids
give repeated results; an empty table gives no rows; other columns, whatever their names, are
ignored. A file that is cut anywhere, fails a checksum or holds more or less than its header
says is a ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import arrow_map, write_table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW_BYTES = WIDTH * CHANNELS
#: Bytes of an image's samples that ``decode_png`` reads if not told otherwise: a guard against files that unpack to anything. ``read`` has none.
LIMIT = 1 << 30
#: Sides of the reduced grey image and of the block of low frequencies.
SMALL, LOW = 32, 8


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of a row, and their number before."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW_BYTES or (ROW_BYTES if not data else 0)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, channels: int = CHANNELS, level: int = 6) -> bytes:
    """An 8-bit PNG (grey or RGB) of whole rows; each row takes the filter none, sub or up whose residues are smallest."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width * channels)
    sub, up = rows.copy(), rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    tried = (rows, sub, up)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in tried])
    kind = cost.argmin(axis=0)
    out = np.empty((len(rows), 1 + rows.shape[1]), np.uint8)
    out[:, 0] = kind
    for k, x in enumerate(tried):
        out[kind == k, 1:] = x[kind == k]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if len(png) - at < 12:
            raise ValueError("the file is cut inside a chunk")
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if len(png) - at < 12 + size or struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"chunk {kind!r} is cut or fails its checksum")
        yield kind, data
        at += 12 + size


def _unpacked(data: bytes, size: int) -> np.ndarray:
    """Exactly ``size`` bytes; what unpacks to more is not unpacked further."""
    unpack = zlib.decompressobj()
    try:
        out = unpack.decompress(data, size + 1)
    except zlib.error as fault:
        raise ValueError(f"the samples are damaged: {fault}") from None
    if len(out) != size or not unpack.eof:
        raise ValueError("the samples are more or less than the header says")
    return np.frombuffer(out, np.uint8)


def _predicted(kind: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each row's filter expects of the left, upper and upper left samples."""
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
    return np.choose(kind[:, None], (0, a, b, (a + b) >> 1, nearest))


def _by_diagonals(kinds: np.ndarray, residues: np.ndarray) -> np.ndarray:
    """Samples of rows of any filters: those of a falling diagonal need earlier diagonals only, so each one is a step."""
    height, width, step = residues.shape
    # One row above and one column to the left are zero.
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        out[y + 1, x + 1] = (residues[y, x] + _predicted(kinds[y], out[y + 1, x], out[y, x + 1], out[y, x])) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(png: bytes, most: int | None = LIMIT) -> np.ndarray:
    """The samples of an 8-bit grey or RGB PNG without interlacing, as (height, width, channels), of at most so many bytes (None: any)."""
    head, data = b"", []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    else:
        raise ValueError("the file has no end chunk")
    if len(head) != 13:
        raise ValueError("the file has no header")
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or color not in (0, 2) or interlace:
        raise ValueError("only 8-bit grey and RGB images without interlacing are read")
    step = {0: 1, 2: 3}[color]
    size = height * (1 + width * step)
    if not size or most is not None and size > most:
        raise ValueError("the image is empty or too large")
    raw = _unpacked(b"".join(data), size).reshape(height, 1 + width * step)
    kinds = raw[:, 0]
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    if (kinds > 2).any():
        return _by_diagonals(kinds, raw[:, 1:].reshape(height, width, step).astype(np.int16))
    out, above = raw[:, 1:].copy(), np.zeros(width * step, np.uint8)
    for kind, line in zip(kinds.tolist(), out, strict=True):
        if kind == 1:
            line[:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        above = line
    return out.reshape(height, width, step)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SMALL)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SMALL))


def _reduced(grey: np.ndarray, axis: int) -> np.ndarray:
    """Means of ``SMALL`` runs along an axis; a shorter axis is stretched."""
    n = grey.shape[axis]
    if n < SMALL:
        return np.take(grey, np.arange(SMALL) * n // SMALL, axis=axis)
    edges = np.arange(SMALL + 1) * n // SMALL
    shape = [1, 1]
    shape[axis] = SMALL
    return np.add.reduceat(grey, edges[:-1], axis=axis) / np.diff(edges).reshape(shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies of the grey image lie over their median."""
    grey = samples.sum(axis=2, dtype=np.int64).astype(np.float64)
    small = _reduced(_reduced(grey, 0), 1)
    c = _cosines()
    low = np.round(c @ small @ c.T, 4).reshape(-1)
    low[0] = 0.0  # the mean brightness says nothing
    return np.packbits(low > np.median(low)).tobytes()


STORED = "doc_id bigint, n_bytes bigint, png binary"
READ = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, cosine_hash binary"
#: Rows of a batch that are handled at a time.
ROWS = 500


def _batches(batch: pa.RecordBatch, schema: str, row: Callable[..., tuple], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        rows = [row(*x) for x in zip(*(c.slice(start, ROWS).to_pylist() for c in batch.columns), strict=True)]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def store(docs: DataFrame, level: int = 6) -> DataFrame:
    """One PNG per row of ``docs`` (doc_id, text), in a table of the shared folder."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        payload, n = payload_of(text or "")
        return doc_id, n, encode_png(payload, level=level)

    kinds = [pa.int64(), pa.int64(), pa.binary()]
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return write_table(arrow_map(wanted, lambda batch: _batches(batch, STORED, row, kinds), STORED), "media")


def read(stored: DataFrame) -> DataFrame:
    """Per row of ``stored``: digests of the stored file and of the payload read back from it, and the image's hash."""

    def row(doc_id: int | None, n: int, png: bytes) -> tuple:
        # Own files are as large as the texts that they hold; only others' are guarded.
        samples = decode_png(png, None)
        back, found = samples.tobytes(), cosine_hash(samples)
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), found.hex(), found

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return arrow_map(stored.select("doc_id", "n_bytes", "png"), lambda batch: _batches(batch, READ, row, kinds), READ)
