"""Whole-column word work on Arrow text, vectorised with numpy (runs inside tasks).

A column of texts is viewed as one flat byte array.  Words are maximal runs of
bytes other than ``\\x20`` and ``\\x09-\\x0D``; those six bytes never occur
inside a multi-byte UTF-8 character, so byte runs and code-point runs agree.
Words, n-grams and windows are compared by 64-bit fingerprints: a polynomial
over a table of random byte values, finished by a mixing step.  Two different
keys share a fingerprint with a chance of about ``pairs / 2^64``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once; a single longer text is handled alone
CHUNK = 2 << 20
#: bytes whose fingerprints are computed at once, also inside one long text
PIECE = 1 << 20

_rng = np.random.default_rng(20_240_229)
BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
GRAM = np.uint64(0xD6E8FEB86659FD93 | 1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch holding about ``max_bytes`` of text each."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo


@dataclass
class Words:
    """Words of several texts: byte spans in ``buf``; the words of row ``r`` are ``first[r]:first[r + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def spans(buf: np.ndarray, offsets: np.ndarray, is_break: np.ndarray) -> Words:
    """Maximal runs of bytes that are no breaks, cut at row boundaries too."""
    if len(buf) == 0:
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(offsets), np.int64))
    inside = ~is_break[buf]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(buf, s, e, np.searchsorted(s, offsets))


def split_words(column: pa.Array, lower: bool = False) -> Words:
    buf, offsets = flat(column)
    return spans(LOWER[buf] if lower else buf, offsets, IS_SPACE)


def fingerprints(w: Words, longest: int | None = None) -> np.ndarray:
    """One 64-bit fingerprint for each word (of its first ``longest`` bytes when given)."""
    n = len(w.start)
    out = np.empty(n, np.uint64)
    end = w.end if longest is None else np.minimum(w.end, w.start + longest)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(w.end, w.start[a] + PIECE, "right")))
        s, length = w.start[a:b], end[a:b] - w.start[a:b]
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        inner = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(at, length)
        value = BYTE_VALUE[w.buf[inner + np.repeat(s, length)]] * powers(BASE, int(length.max()))[inner]
        out[a:b] = np.add.reduceat(value, at)
        a = b
    return mix(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` words, by doubling; entry i covers words i to i + k - 1.

    Runs over row boundaries are included; callers mask them.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pw = powers(GRAM, k + 1)
    out, size, block, done = None, 1, h, 0
    while True:
        if k & size:
            if out is None:
                out, done = block, size
            else:
                m = min(len(out), len(block) - done)
                out = out[:m] * pw[size] + block[done:done + m]
                done += size
        if size * 2 > k:
            break
        m = len(block) - size
        block = block[:m] * pw[size] + block[size:]
        size *= 2
    return mix(out[:n])


def in_row(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over the ``n`` run starts: True where the run of ``k`` words stays in one row."""
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = first[1:-1] - back
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... for each (start, length) pair, in one array."""
    at = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, np.int64)
    return np.arange(int(length.sum()), dtype=np.int64) + np.repeat(start - at, length)
