"""Whole Arrow text columns as byte arrays: word borders and 64-bit word hashes without a Python string per row.

Texts are cut into chunks of bounded bytes, so temporaries stay small however long a batch is; one
text longer than a chunk makes a chunk of its own. Null texts read as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def byte_class(ranges, inside=True) -> np.ndarray:
    """Table of 256 flags: bytes within (or outside) the inclusive ranges."""
    out = np.full(256, not inside)
    for lo, hi in ranges:
        out[lo:hi + 1] = inside
    return out


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SAME_BYTES = np.arange(256, dtype=np.uint8)


def text_chunks(column: pa.Array, limit=CHUNK_BYTES):
    """(first row, bytes as uint8, offsets as int64 from 0) of runs of rows of about ``limit`` bytes."""
    column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, ends, body = column.buffers()
    offs = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[offs[row]:offs[stop]], offs[row:stop + 1] - offs[row]
        row = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data, offs, inside):
    """Start and end byte of every maximal run of bytes of the class; runs end at text borders."""
    w = inside[data]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty_like(w)
    first[0], first[1:] = True, ~w[:-1]
    heads = offs[:-1][offs[:-1] < len(w)]
    first[heads] = True
    last = np.empty_like(w)
    last[-1], last[:-1] = True, ~w[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = True
    return np.flatnonzero(w & first), np.flatnonzero(w & last) + 1


class SpanHasher:
    """64-bit hashes of any spans of a chunk's bytes, folded by a byte table: polynomial sums, mixed with the length."""

    def __init__(self, data, fold=SAME_BYTES):
        one, back = np.uint64(1), np.uint64(pow(int(BASE), -1, 1 << 64))
        salt = mix64(np.arange(1, 257, dtype=np.uint64) * BASE)[fold]
        power = np.full(len(data), BASE, np.uint64)
        power[:1] = one
        np.multiply.accumulate(power, out=power)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(salt[data] * power, out=self.sums[1:])
        power[:] = back
        power[:1] = one
        self.inverse = np.multiply.accumulate(power, out=power)

    def __call__(self, starts, ends) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix64(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def span_hashes(data, starts, ends, fold=SAME_BYTES) -> np.ndarray:
    return SpanHasher(data, fold)(starts, ends)


def words_of_rows(starts, offs):
    """Index of the first word of each row, with one more entry at the end."""
    return np.searchsorted(starts, offs, side="left")

