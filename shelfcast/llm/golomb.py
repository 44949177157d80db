"""Golomb-Rice codes of sorted integers, vectorised.

A list of n sorted values below ``span`` is stored as its first value and the
gaps: each gap's high part in unary, its low ``k`` bits plain, with k near the
logarithm of the mean gap. That is about log2(span / n) + 1.5 bits a value.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBQ")


def encode(values: np.ndarray, span: int) -> bytes:
    """``values``: ascending uint64 below span, repeats allowed."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    k = max(0, int(max(span // n, 1) * 0.69).bit_length() - 1)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return (
        _HEAD.pack(n, k, len(unary))
        + np.packbits(unary).tobytes()
        + np.packbits(low.astype(np.uint8).reshape(-1)).tobytes()
    )


def decode(blob: bytes) -> np.ndarray:
    n, k, bits = _HEAD.unpack_from(blob)
    if not n:
        return np.empty(0, np.uint64)
    at, size = _HEAD.size, (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, at))[:bits]
    high = np.diff(np.flatnonzero(unary), prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + size))[: n * k].reshape(n, k).astype(np.uint64)
    gaps = (high << np.uint64(k)) + (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
