"""Sorted runs of suffixes: front coding, and merging by a tree of losers that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


class Suffix(NamedTuple):
    """One of the distinct suffixes of a corpus, with what stands before it."""

    ahead: bytes
    #: The bytes before it, in reverse.
    behind: bytes
    least: int
    #: Whether it occurs more than once.
    many: bool
    name: bytes


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree in ``known`` bytes."""
    most, step = min(len(a), len(b)), 16
    while known < most:
        if a[known : known + step] != b[known : known + step]:
            while known < most and a[known] == b[known]:
                known += 1
            return known
        known, step = known + step, 4 * step
    return most


def encode(run: Sequence[Suffix]) -> bytes:
    """A sorted run, front-coded: of each suffix only what follows the prefix it shares with the one before."""
    shared = [0] + [common_prefix(a.ahead, b.ahead) for a, b in zip(run, run[1:])]
    tails = [s.ahead[n:] for s, n in zip(run, shared)]
    numbers = np.array([shared, [len(t) for t in tails], [len(s.behind) for s in run], [s.least for s in run], [s.many for s in run]], "<i4")
    parts = [np.int64(len(run)).tobytes(), numbers.tobytes(), *(s.name for s in run), *tails, *(s.behind for s in run)]
    raw = b"".join(parts)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, _CODEC, asbytes=True)


def decode(blob: bytes) -> tuple[list[Suffix], list[int]]:
    """The suffixes of a run, and how many bytes each shares with the one before it."""
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = pa.decompress(blob[8:], size, _CODEC, asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    shared, tails, behind, least, many = np.frombuffer(raw, "<i4", 5 * n, 8).reshape(5, n).tolist()
    names, at = 8 + 20 * n, 8 + 36 * n
    to = at + sum(tails)
    out, ahead = [], b""
    for k in range(n):
        ahead = ahead[: shared[k]] + raw[at : at + tails[k]]
        name = raw[names + 16 * k : names + 16 * k + 16]
        out.append(Suffix(ahead, raw[to : to + behind[k]], least[k], bool(many[k]), name))
        at, to = at + tails[k], to + behind[k]
    return out, shared


def merge(runs: Sequence[tuple[Sequence[Suffix], Sequence[int]]]) -> Iterator[tuple[Suffix, int]]:
    """All suffixes in order, each with the length of the prefix it shares with the one before.

    A loser knows how many bytes it shares with the winner it lost to. Of two
    contenders for the next place, both known to that last winner, the one that
    shares more with it is the smaller; only at equal lengths are bytes read,
    and only those behind the known prefix.
    """
    runs = [run for run in runs if run[0]]
    if not runs:
        return
    size = 1 << (len(runs) - 1).bit_length()
    heads: list[bytes | None] = [run[0][0].ahead for run in runs] + [None] * (size - len(runs))
    known, place, losers = [0] * size, [0] * len(runs), [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two contenders."""
        left, right = heads[a], heads[b]
        if right is None:
            return a, b
        if left is None or known[a] < known[b]:
            return b, a
        if known[a] > known[b]:
            return a, b
        n = common_prefix(left, right, known[a])
        first = n == len(left) or (n < len(right) and left[n] < right[n])
        winner, loser = (a, b) if first else (b, a)
        known[loser] = n
        return winner, loser

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner] is not None:
        suffixes, shared = runs[winner]
        k = place[winner]
        yield suffixes[k], known[winner]
        place[winner] = k = k + 1
        if k < len(suffixes):
            heads[winner], known[winner] = suffixes[k].ahead, shared[k]
        else:
            heads[winner] = None
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
