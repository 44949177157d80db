"""Periodic runs of words, by online dyadic square catching.

A run of smallest period q and at least four periods holds, for the power of
two B with B <= q < 2 * B, a whole block of B words that starts at a multiple
of B less than B words after the run does. Every completed block of B words
gets a catcher. It watches the words appended after it: when the last B words
equal its own, at a distance q from B to 2 * B - 1, it has caught a square of
period q, and it goes on comparing to the third period, since shorter
repetitions are no runs. Equal suffixes of B words are found by their hashes,
which double from level to level; a level of catchers advances as arrays, over
all documents of a batch. What is caught is extended both ways over the words
themselves and merges into runs, the smaller periods first: a square inside a
run whose period divides its own is part of that run.

A word is compared at most once by each level's catchers, so n words cost
about n * log2(n) hash comparisons.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.hashing import mix64, segment_hashes, slices, text_bytes, word_spans

#: A run has at least so many periods, and at least so many words.
PERIODS = 4
LEAST_WORDS = 6
#: Comparisons of catchers that are held as arrays at a time.
_STEP = 1 << 20
_DOUBLE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def catch_squares(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For B = 1, 2, 4 and so on (B, document, start of the block, distance) of what the catchers
    of B words report. ``words`` are 64-bit hashes, ``first`` the n + 1 bounds of documents."""
    lengths = np.diff(first)
    docs, hashes, block = np.arange(len(lengths)), words, 1
    while True:
        long = lengths >= max(LEAST_WORDS, PERIODS * block)
        if not long.any():
            return
        if not long.all():
            hashes = hashes[np.repeat(long, lengths)]
            docs, lengths = docs[long], lengths[long]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        caught = [_advance(hashes, block, *part) for part in _catchers(block, bounds, lengths)]
        doc, start, distance = (np.concatenate(x) for x in zip(*caught))
        yield block, docs[doc], start - bounds[doc], distance
        joined = hashes * _DOUBLE
        joined[:-block] += hashes[block:]
        hashes, block = mix64(joined), 2 * block


def _catchers(block: int, bounds: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, number of distances to watch) of completed blocks, some at a time."""
    blocks = np.maximum(0, (lengths - 3 * block) // block + 1)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * block
    # Three periods after the block's start must fit into the document.
    watched = np.clip((lengths[doc] - 1 - inside) // 3 + 1 - block, 0, block)
    step = max(1, _STEP // block)
    for at in range(0, max(1, len(doc)), step):
        part = slice(at, at + step)
        yield doc[part], bounds[doc[part]] + inside[part], watched[part]


def _advance(hashes: np.ndarray, block: int, doc: np.ndarray, start: np.ndarray, watched: np.ndarray):
    """What these catchers report when all words they watch have been appended."""
    before = np.cumsum(watched) - watched
    row = np.repeat(np.arange(len(start)), watched)
    distance = np.arange(len(row)) - np.repeat(before, watched) + block
    equal = hashes[start[row]] == hashes[start[row] + distance]
    row, distance = row[equal], distance[equal]
    # Of the first block of a run, the words up to the third period go on being equal.
    for third in (False, True):
        at = start[row] + (2 * distance + 1 - block if third else block)
        equal = hashes[at] == hashes[at + distance]
        row, distance = row[equal], distance[equal]
    return doc[row], start[row], distance


def _equal_ahead(ids: np.ndarray, left: int, right: int) -> int:
    """How many words from left on equal those from right on (left < right)."""
    done, step, n = 0, 64, len(ids) - right
    while done < n:
        to = min(n, done + step)
        unequal = np.flatnonzero(ids[left + done : left + to] != ids[right + done : right + to])
        if len(unequal):
            return done + int(unequal[0])
        done, step = to, 4 * step
    return n


def merge_runs(ids: np.ndarray, reports: list[tuple[int, np.ndarray, np.ndarray]]) -> list[Run]:
    """The runs of one document, by start and period. ``ids`` are equal where words are;
    ``reports`` the (B, starts, distances) of its catchers, B ascending."""
    back = ids[::-1]
    runs: list[Run] = []
    for block, starts, distances in reports:
        waiting, open_runs = iter(list(runs)), []
        upcoming = next(waiting, None)
        for k in np.lexsort((distances, starts)):
            start, period = int(starts[k]), int(distances[k])
            while upcoming is not None and upcoming.start <= start:
                open_runs.append(upcoming)
                upcoming = next(waiting, None)
            open_runs = [r for r in open_runs if r.start + r.length > start]
            end = start + period + block
            if any(end <= r.start + r.length and period % r.period == 0 for r in open_runs):
                continue
            ahead = _equal_ahead(ids, start, start + period)
            behind = _equal_ahead(back, len(ids) - start - period, len(ids) - start)
            run = Run(start - behind, behind + ahead + period, period)
            if run.length >= max(LEAST_WORDS, PERIODS * period):
                insort(runs, run)
                open_runs.append(run)
    smallest: dict[tuple[int, int], Run] = {}
    for run in runs:
        smallest.setdefault((run.start, run.length), run)
    return sorted(smallest.values(), key=lambda r: (r.start, r.period))


def _word_ids(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        edges[run.start + run.period] += 1
        edges[run.start + run.length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def runs_of_texts(column: pa.Array) -> Iterator[tuple[int, list[Run], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    data, bounds = text_bytes(column)
    starts, ends, first = word_spans(data, bounds)
    reports = defaultdict(list)
    for block, doc, start, distance in catch_squares(segment_hashes(data, starts, ends), first):
        cuts = np.flatnonzero(np.diff(doc)) + 1 if len(doc) else []
        for part in np.split(np.arange(len(doc)), cuts):
            if len(part):
                reports[int(doc[part[0]])].append((block, start[part], distance[part]))
    for k in range(len(column)):
        words = data[bounds[k] : bounds[k + 1]].tobytes().split()
        found = merge_runs(_word_ids(words), reports[k]) if k in reports else []
        yield len(words), found, b" ".join(_collapse(words, found) if found else words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        counts, runs, texts = zip(*runs_of_texts(piece.column("text")))
        found = pa.array([[r._asdict() for r in of_text] for of_text in runs], _RUNS)
        collapsed = pa.array(texts, pa.binary()).cast(pa.string())
        columns = [piece.column("id"), pa.array(counts, pa.int64()), found, collapsed]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D. ``runs``
    lists every stretch of smallest period q and max(6, 4 * q) words or more
    that no neighbouring word extends, by start and period; ``collapsed`` joins
    by one space the words that no run contains after its first q words.

    One pass over the rows, without a shuffle: a document is never split, and a
    task holds one batch of texts, or one very long text.

    Defined cases: a null text counts as empty and has no words, no runs and an
    empty collapsed text, like a text of white space. Ids are only carried:
    nulls and repeated rows give a row each. Other columns are not read. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_found, schema).withColumnRenamed("id", id_col)
