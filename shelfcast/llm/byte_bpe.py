"""Byte-level BPE encoding and decoding by a file of ranks.

Two tiers: a minimal perfect hash over the vocabulary answers at once for
every pre-token that is itself a token; any other is merged from its bytes,
which form a linked list, by a heap of neighbouring pairs in rank order.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from shelfcast.llm import hashing
from shelfcast.llm.tokens import PieceStore, flat_ids, is_plain, plain_pattern


class PerfectHash:
    """Maps each of n byte strings to its own number below n (hash and displace).

    Keys fall into buckets by one hash; larger buckets are placed first, each
    with the first displacement that sends its keys to free slots; a bucket of
    one key names its slot outright.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        hashes = _hash_all(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        self.buckets = max(1, n // 3)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        own = (hashes % np.uint64(self.buckets))[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        groups = sorted(np.split(order, cuts), key=len, reverse=True) if n else []
        self.displace = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        self.slot_key = np.zeros(n, np.int64)
        self.n, rest = n, []
        for group in groups:
            if len(group) == 1:
                rest.append(group[0])
                continue
            h, d = hashes[group], 1
            while True:
                slots = self._displaced(h, np.int64(d))
                if len(set(slots.tolist())) == len(slots) and not taken[slots].any():
                    break
                d += 1
            taken[slots] = True
            self.slot_key[slots] = group
            self.displace[int(h[0] % np.uint64(self.buckets))] = d
        free = np.flatnonzero(~taken)
        for key, slot in zip(rest, free.tolist()):
            self.slot_key[slot] = key
            self.displace[int(hashes[key] % np.uint64(self.buckets))] = -slot - 1

    def _displaced(self, hashes: np.ndarray, by) -> np.ndarray:
        return (hashing.mix64(hashes ^ (np.asarray(by).astype(np.uint64) * np.uint64(_SPREAD))) % np.uint64(self.n)).astype(
            np.int64
        )

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each string the number of the only key that it can equal."""
        hashes = _hash_all(keys)
        by = self.displace[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_key[np.where(by < 0, -by - 1, self._displaced(hashes, np.abs(by)))]


_SPREAD = 0x9E3779B97F4A7C15


def _hash_all(keys: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))
    data = np.frombuffer(b"".join(keys), np.uint8)
    return hashing.segment_hashes(data, np.concatenate([[0], ends[:-1]]) if len(keys) else ends, ends)


class ByteBpe:
    """Encodes and decodes by ``ranks``, a file of base64 tokens and their ids."""

    def __init__(self, ranks: str, pattern: str, memo: int = 400_000):
        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.keys = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int32, len(self.keys))
        self.whole = PerfectHash(self.keys)
        self.split, self.plain_split = regex.compile(pattern), plain_pattern(pattern)
        self.token_bytes = {i: k for k, i in self.ranks.items()}
        self.store = PieceStore(self.pieces, memo)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token that is not a token: the pair of lowest rank, leftmost first, is merged."""
        n, rank = len(word), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if (r := rank(word[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, left, mid, end = heapq.heappop(heap)
            if not alive[left] or after[left] != mid or mid >= n or after[mid] != end:
                continue
            alive[mid] = False
            after[left] = end
            if end < n:
                before[end] = left
                if (r := rank(word[left : after[end]])) is not None:
                    heapq.heappush(heap, (r, left, end, after[end]))
            if (p := before[left]) >= 0 and (r := rank(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, left, end))
        out, at = [], 0
        while at < n:
            out.append(self.ranks[word[at : after[at]]])
            at = after[at]
        return out

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token, flat, and their numbers: one look-up if it is a token, else its merges."""
        words = [w.encode() for w in pieces]
        found = zip(words, self.whole.candidates(words).tolist())
        return flat_ids([[int(self.ids[key])] if self.keys[key] == word else self.merge(word) for word, key in found])

    def column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each match of the pattern encoded separately, and the n + 1 bounds of each text's ids."""
        return self.store.column([(self.plain_split if is_plain(t) else self.split).findall(t) for t in texts])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_models: dict[tuple[str, str], ByteBpe] = {}


def model(ranks: str, pattern: str) -> ByteBpe:
    """One model for each vocabulary in a Python worker."""
    if (ranks, pattern) not in _models:
        _models[ranks, pattern] = ByteBpe(ranks, pattern)
    return _models[ranks, pattern]


def encode_documents(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False
) -> DataFrame:
    """(id_col, ids array<int>) of every row's whole text, one row for one row;
    with ``decode`` also ``decoded``, the bytes that these ids stand for.

    Defined cases: a null or empty text has no ids (an empty array). Text like
    a special token is ordinary text. Rows that repeat an id, or have none, are
    encoded each for itself. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks, pattern)
        for piece in hashing.slices(batches, "text", 4 << 20):
            ids, bounds = bpe.column([t or "" for t in piece.column("text").to_pylist()])
            columns = [piece.column("id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
            if decode:
                listed = ids.tolist()
                texts = [bpe.decode(listed[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns.append(pa.array(texts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, ids array<int>" + (", decoded binary" if decode else "")
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the bytes that ids_col stands for.

    Defined cases: null ids decode to no bytes. An unknown id is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [bpe.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"]
                )

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))
