"""Anchors: places of a text that its windows choose by their content alone.

Of the ``span`` places at the beginning of a window, the one whose next few
bytes have the least hash is the window's anchor (the first of equal ones).
Equal windows have their anchors at the same distance, wherever they stand, so
windows need only be compared where their anchors' surroundings agree.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from shelfcast.llm.hashing import segment_hashes

_GRAM = 8
_SLAB = 1 << 15
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64((1 << 32) - 1)


class Anchors(NamedTuple):
    """All arrays have one value for each anchor, in the order of places."""

    doc: np.ndarray
    #: Place in the text, in bytes.
    place: np.ndarray
    #: Least and largest distance of the windows that chose it.
    least: np.ndarray
    most: np.ndarray
    #: Hash of the bytes from the place on that all windows of the largest distance hold.
    key: np.ndarray


def span_of(width: int) -> int:
    """Places of a window among which its anchor is chosen."""
    return max(1, width * 5 // 8)


def common_bytes(width: int) -> int:
    """Bytes from an anchor on that every window which chose it holds."""
    return width - span_of(width) + 1


def _least_places(data: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For each place the one of the ``span`` from it on with the least hash of ``gram`` bytes."""
    padded = np.concatenate([data, np.zeros(span + _GRAM, np.uint8)])
    grams = np.ndarray((len(data) + span,), "<u8", padded, strides=(1,))
    out = np.empty(len(data), np.int64)
    for at in range(0, len(data), _SLAB):
        part = grams[at : min(at + _SLAB, len(data)) + span - 1]
        order = (part & np.uint64((1 << 8 * gram) - 1)) * _MULTIPLY
        order ^= order >> np.uint64(29)
        order *= _MULTIPLY
        order &= ~_PLACE
        order |= np.arange(len(part), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            order = np.minimum(order[:-step], order[step:])
            step *= 2
        if step < span:
            order = np.minimum(order[: len(order) - span + step], order[span - step :])
        out[at : at + len(order)] = (order & _PLACE).astype(np.int64) + at
    return out


def find_anchors(data: np.ndarray, bounds: np.ndarray, width: int) -> Anchors:
    """The anchors of all windows of ``width`` bytes inside the texts data[bounds[i]:bounds[i + 1]]."""
    span = span_of(width)
    windows = np.maximum(0, np.diff(bounds) - width + 1)
    doc = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[doc]
    if not len(doc):
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64))
    place = _least_places(data, span, min(_GRAM, width - span + 1))[start]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:], [len(place)]]) - 1
    at = place[new]
    key = segment_hashes(data, at, at + common_bytes(width))
    return Anchors(doc[new], at - bounds[doc[new]], at - start[last], at - start[new], key)
