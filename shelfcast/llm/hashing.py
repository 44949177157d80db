"""Vectorised word and shingle hashes over the bytes of many texts at once.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, lower-cased
in A-Z only. A word's 64-bit hash is a polynomial in its bytes, taken from
prefix sums, then mixed; a shingle's hash combines those of its words in order.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 18
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_P, _P_INV):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            tables.append(np.cumprod(step))
        if size > 2 * _BLOCK:  # one very long word: not worth keeping
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] (ascending, not overlapping)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        pw, ipw = power_tables(top - base + 1)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * pw[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix64((sums[e] - sums[s]) * ipw[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of data, and for each segment
    data[bounds[i]:bounds[i + 1]] the number of words before it (n + 1 values)."""
    word = ~_SPACE[data]
    left = np.ones(len(data) + 1, bool)
    left[1:] = ~word
    left[bounds] = True
    starts = np.flatnonzero(word & left[:-1])
    last = np.ones(len(data), bool)
    last[:-1] = ~word[1:]
    inner = bounds[(bounds > 0) & (bounds <= len(data))]
    last[inner - 1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of data, and each segment's first word (n + 1 values)."""
    data = _LOWER[data]
    starts, ends, first = word_spans(data, bounds)
    return segment_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of a shorter sequence, one of the whole."""
    if not len(words):
        return np.empty(0, np.uint64)
    n, step, whole = min(width, len(words)), 0xFF51AFD7ED558CCD, 1 << 64
    # Polynomials in ``step`` with the words as coefficients, by doubling.
    have, out = 1, words
    for bit in bin(n)[3:]:
        out = out[:-have] * np.uint64(pow(step, have, whole)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(step) + words[have : have + len(out) - 1]
            have += 1
    return mix64(out + np.uint64(n * pow(step, n, whole) % whole))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null as empty) and the n + 1 bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return packed_bytes(pc.fill_null(column, ""))


def packed_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and the n + 1 bounds of its rows."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(length[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(length, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def trim() -> None:
    """What Arrow and the C library hold back for later would add up over the workers of an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
