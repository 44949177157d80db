"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of a growing dictionary (LZ78, over UTF-8
bytes); the hashes of its phrases form a set, of which ``VALUES`` minima are
taken and of each the low 8 bits retained. Two texts are as alike as their phrase
sets overlap, which follows how well one compresses given the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm import hashing

VALUES = 128
#: The dictionary starts anew when it holds so many phrases, so memory is bounded for any text.
DICTIONARY = 1 << 20
#: Rows in a range of ids, at most on average, and the least number of ranges.
RANGE_ROWS = 1 << 16
LEAST_RANGES = 64


class Parse:
    """An LZ78 parse that can be copied and continued."""

    def __init__(self, most: int = DICTIONARY):
        self.trie: dict[int, int] = {}
        self.node, self.at, self.most = 0, 0, most
        self.ends: list[int] = []

    def copy(self) -> Parse:
        other = Parse(self.most)
        other.trie, other.node, other.at, other.ends = self.trie.copy(), self.node, self.at, self.ends.copy()
        return other

    def feed(self, data: bytes) -> Parse:
        trie, node, ends = self.trie, self.node, self.ends
        get, ended, number = trie.get, ends.append, len(trie)
        for at, c in enumerate(data, self.at + 1):
            key = node << 8 | c
            node = get(key)
            if node is None:
                number += 1
                trie[key] = number
                node = 0
                ended(at)
                if number >= self.most:
                    trie.clear()
                    number = 0
        self.node, self.at = node, self.at + len(data)
        return self


class Fingerprinter:
    def __init__(self, values: int = VALUES):
        rng = np.random.default_rng(78_1978)
        self.values = values
        self.a = (rng.integers(0, 1 << 32, values, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, values, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = np.arange(values, dtype=np.uint64) << np.uint64(32)

    def of(self, data: bytes, ends: list[int]) -> str:
        """Hex digits of the fingerprint of data whose phrases end at ``ends``; empty for no phrase."""
        if not ends:
            return ""
        stops = np.array(ends, np.int64)
        starts = np.concatenate([[0], stops[:-1]])
        phrases = hashing.segment_hashes(np.frombuffer(data, np.uint8), starts, stops)
        h = (phrases >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.values, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 4096):
            np.minimum(low, (self.a * h[None, at : at + 4096] + self.b).min(axis=1), out=low)
        return (hashing.mix64(low.astype(np.uint64) + self.salt) & np.uint64(0xFF)).astype(np.uint8).tobytes().hex()

    def text(self, text: str) -> str:
        data = text.encode()
        return self.of(data, Parse().feed(data).ends)


def likeness(one: str, two: str) -> float:
    """Share of equal values of two fingerprints, corrected for chance agreement, from 0 to 1.

    Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    if not one or not two:
        return float(one == two)
    a, b = np.frombuffer(bytes.fromhex(one), np.uint8), np.frombuffer(bytes.fromhex(two), np.uint8)
    return max(0.0, (float((a == b).mean()) - 1 / 256) / (1 - 1 / 256))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row's whole text; null counts as empty, whose fingerprint is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter()
        for piece in hashing.slices(batches, "text", 4 << 20):
            found = [own.text(t or "") for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(found, pa.string())], names=["id", "fingerprint"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


_EDITED = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Document:
    """A text with its fingerprint, and its parse up to where an edit would begin."""

    def __init__(self, ident: int | None, text: str, own: Fingerprinter):
        self.ident, self.text = ident, text
        self.n = len(text)
        self.cut = self.n - self.n // 3
        self.head = text[: self.cut].encode()
        self.parse = Parse().feed(self.head)
        tail = text[self.cut :].encode()
        whole = self.parse.copy().feed(tail)
        self.fingerprint = own.of(self.head + tail, whole.ends)

    def beside(self, other: _Document, own: Fingerprinter) -> tuple:
        new = other.text[: self.n // 3].encode()
        edited = self.head + new
        print_ = own.of(edited, self.parse.feed(new).ends)
        return (
            self.ident, self.n, hashlib.sha256(edited).hexdigest(), self.fingerprint, print_,
            likeness(self.fingerprint, print_), likeness(self.fingerprint, other.fingerprint),
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in order, and after each range's rows the first row of the next."""
    own, held, bucket = Fingerprinter(), None, None
    names = [x.split()[0] for x in _EDITED.split(", ")]
    for piece in hashing.slices(batches, "text", 4 << 20):
        rows = []
        for at, ident, text, last in zip(
            piece.column("bucket").to_pylist(), piece.column("id").to_pylist(), piece.column("text").to_pylist(),
            piece.column("follows").to_pylist(),
        ):
            here = _Document(ident, text or "", own)
            if held is not None and at == bucket:
                rows.append(held.beside(here, own))
            held, bucket = (None if last else here), at
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _bucket(ident: Column, cuts: list[float], least: int, most: int, parts: int) -> Column:
    """The range of an id: between which cuts it lies, and which of ``parts`` equal parts of that."""
    edges = [float(least), *cuts, float(most) + 1]
    at = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= ident)) if cuts else F.lit(0)
    low, high = (F.element_at(F.array(*[F.lit(x) for x in edges]), at + k) for k in (1, 2))
    within = F.floor((ident - low) / F.greatest(high - low, F.lit(1.0)) * parts)
    return at.cast("long") * parts + F.least(F.greatest(within, F.lit(0)), F.lit(parts - 1)).cast("long")


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text beside an edit of it and beside the next row's text, by their fingerprints.

    Rows are in order of descending id, and the first follows the last. The
    edit replaces the last floor(n / 3) code points by the first as many, or
    all, of the next row's text. Returns (id_col, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next).

    Defined cases: a null text counts as empty; rows with a null id come last;
    rows that repeat an id are ordered by a hash of the text; a single row is
    its own next. Other columns are not read. An empty table gives no rows.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    n, least, most = source.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    least, most = least or 0, most or 0
    ranges = max(LEAST_RANGES, n // RANGE_ROWS)
    parts = -(-ranges // 256)
    wanted = ranges // parts
    cuts = source.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.25 / wanted) if n else []
    cuts = sorted(set(cuts) - {float(least)})
    # Ranges descend with the number; ids without a value stand in the last.
    total = (len(cuts) + 1) * parts
    bucket = F.coalesce(F.lit(total - 1) - _bucket(F.col("id"), cuts, least, most, parts), F.lit(total).cast("long"))
    rows = source.withColumns({"bucket": bucket, "down": F.bitwise_not("id"), "h": F.xxhash64("text")})

    heads = rows.groupBy("bucket").agg(F.min(F.struct("down", "h")).alias("head"))
    before = Window.orderBy("bucket")  # one row for each range
    first = F.max("bucket").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(before), first).alias("target"))
    heads = heads.select(F.col("head.down").alias("down"), F.col("head.h").alias("h"), "target")
    match = rows["down"].eqNullSafe(heads["down"]) & (rows["h"] == heads["h"])
    follow = rows.join(F.broadcast(heads) if ranges <= 100_000 else heads, match)
    follow = follow.select(F.col("target").alias("bucket"), "id", "text", rows["down"], rows["h"], F.lit(True).alias("follows"))
    # Copies of a row under one id are alike, so any one of them may follow.
    follow = follow.dropDuplicates(["bucket"])
    ordered = (
        rows.select("bucket", "id", "text", "down", "h", F.lit(False).alias("follows"))
        .unionByName(follow)
        .repartition(total + 1, "bucket")
        .sortWithinPartitions("bucket", "follows", F.asc_nulls_last("down"), "h")
    )
    out = ordered.select("bucket", "id", "text", "follows").mapInArrow(_compare, _EDITED)
    return out.withColumnRenamed("id", id_col)
