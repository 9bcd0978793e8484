"""Words and shingles of whole Arrow text columns, with numpy.

A text column arrives in tasks as one UTF-8 buffer with offsets.  Words are
maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased, so
they are found on the bytes without decoding.  A word's 64-bit hash is a
difference of prefix sums of a polynomial over the buffer.  Chunks of about a
megabyte (or one longer text) bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_LETTER = np.ones(256, bool)  # for words of letters only: ASCII letters and all bytes of longer characters
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n at least.  Kept for later calls up to
    two chunks; those of a longer text go with it."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    size = 1 << (n - 1).bit_length()
    made = []
    for r in (_R, _R_INV):
        a = np.full(size, r, np.uint64)
        a[0] = 1
        made.append(np.multiply.accumulate(a, out=a))
    if size <= 2 * CHUNK_BYTES:
        _POWERS[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of the rows i..j-1 of a column: byte ranges, hashes, row bounds.
    ``between`` marks the bytes that separate words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, lower: bool = True,
                 between: np.ndarray = _SPACE):
        base = int(off[i])
        b = data[base:int(off[j])]
        rel = off[i:j + 1] - base
        n = len(b)
        self.data, self.rel = b, rel
        space = between[b]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            first = rel[:-1]
            before[first[first < n]] = True
            last = rel[1:] - 1
            after[last[last >= 0]] = True
        word = ~space
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[b] * power[:n], out=total[1:])
        self._total, self._inverse = total, inverse
        self.hash = self.part(self.start, self.end)
        self.bounds = np.searchsorted(self.start, rel)  # words of row k: bounds[k]..bounds[k+1]

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return mix((self._total[end] - self._total[start]) * self._inverse[start])

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def shingles(self, k: int) -> list[np.ndarray]:
        """Per row the sorted distinct hashes of its k-word shingles; with fewer
        words, of the whole sequence; without words, none."""
        h = self.hash
        m = len(h)
        if m >= k:
            s = h[:m - k + 1] * _SHINGLE[0]
            for x in range(1, k):
                s = s + h[x:m - k + 1 + x] * _SHINGLE[x]
            s = mix(s)
        else:
            s = np.zeros(0, np.uint64)
        out = []
        for a, z in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            if z - a >= k:
                out.append(distinct(s[a:z - k + 1]))
            elif z > a:
                v = (h[a:z] * _SHINGLE[k:k + z - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix(v + np.uint64(z - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    a = np.sort(a)
    keep = np.empty(len(a), bool)
    keep[:1] = True
    np.not_equal(a[1:], a[:-1], out=keep[1:])
    return a[keep]


def text_words(column: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES,
               between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) chunk by chunk over a whole column."""
    data, off = buffers(column)
    for i, j in chunks(off, limit):
        yield i, j, Words(data, off, i, j, lower, between)


def run_over(table: pa.RecordBatch, limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (or one row)."""
    k = table.schema.get_field_index(column)
    _, off = buffers(table.column(k))
    for i, j in chunks(off, limit):
        yield table.slice(i, j - i)
