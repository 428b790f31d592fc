"""Numpy kernels over the UTF-8 bytes of Arrow text columns.

A batch is handled as one byte buffer with offsets, so that lower-casing, word boundaries and hashes of any
byte range take a few vector operations, whatever the length of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (one longer text is still handled whole).
CHUNK_BYTES = 4 << 20

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the rolling hash, its inverse modulo 2**64, and a random value for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i up to n, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        for name, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have up to limit bytes together; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    offsets = np.frombuffer(filled.buffers()[1], np.int32)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Hasher:
    """Hashes of any byte range of a buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        self.up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTE_VALUES[buf] * self.up[: len(buf)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(U64))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the first of its words (one entry more than rows)."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    stops = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """The row of each element, from the offsets of the rows."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; an empty run gives 0."""
    return np.bincount(segment_ids(offsets), weights=values, minlength=len(offsets) - 1)


def crc_held_out(column: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    """crc32 of the id as text modulo modulus is remainder; a null id is not held out."""
    import zlib

    return np.array([x is not None and zlib.crc32(str(x).encode()) % modulus == remainder for x in column.to_pylist()], bool)
