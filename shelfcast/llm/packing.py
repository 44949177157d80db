"""Best-fit packing of token sequences into sequences of fixed length.

Documents are tokenised and closed with an end id. Only what is longer than a
sequence is cut. Pieces are dealt into shards by a hash and packed shard by
shard: longest first, each into the open bin that it fills best. Open bins are
kept by free space, and a bitset of the free spaces that occur finds the best
fit in one shift and one lowest-bit step. At most ``open_bins`` bins are open;
beyond that the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.hashing import slices
from shelfcast.llm.tokens import cached_encoder

SEQUENCE = 2048
#: Documents in a shard, on average: one bin in some thousands stays part-filled at a shard's end.
SHARD_DOCS = 1 << 13
OPEN_BINS = 1 << 13
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Bounded-space online best fit over bins of ``size``."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.open_bins, self.next_bin = size, open_bins, first
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.spaces = 0
        self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it where an item of 1 to ``size`` goes."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.next_bin
            self.next_bin += 1
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.spaces |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        return number, self.size - space

    def _take(self, space: int) -> int:
        number = self.by_space[space].pop()
        if not self.by_space[space]:
            self.spaces &= ~(1 << space)
        self.open -= 1
        return number


def _tokenise(make_encoder: Callable, args: tuple, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder(make_encoder, *args)
        for part in slices(batches, "text"):
            ids, bounds = encoder.column(part.column("text"))
            doc, piece, start, length, crc = [], [], [], [], []
            for i in range(part.num_rows):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.int32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), size)):
                    cut = own[at : at + size]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(doc, pa.int32())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    part.column("tie").take(pa.array(doc, pa.int32())),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"],
            )

    return run


def _pack(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for batch in batches:
            bins, offsets = [], []
            for own, length in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist()):
                if own != shard:
                    shard, packer = own, BestFit(size, open_bins, own << 40)
                number, offset = packer.place(length)
                bins.append(number)
                offsets.append(offset)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    make_encoder: Callable,
    *args: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    ``make_encoder(*args)`` gives an encoder (see ``tokens``) in each Python worker. A
    document is its ids and one ``end_id``; if longer than ``size`` it is cut
    into pieces of ``size``, of which the last may be shorter. ids_crc32 is of
    the piece's ids as little-endian unsigned 32-bit integers.

    Defined cases: a null or empty text is the end id alone. Rows that repeat
    an id, and rows with a null id, are packed each for itself. Other columns
    are not read, so their names cannot clash. An empty table gives no rows.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).withColumn("tie", F.xxhash64("id", "text"))
    pieces = source.mapInArrow(_tokenise(make_encoder, args, size, end_id), _PIECES)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("tie", "piece"), F.lit(shards)).cast("long"))
    order = ["shard", F.desc("length"), "tie", "piece"]
    packed = (
        dealt.repartition(shards, "shard").sortWithinPartitions(*order).mapInArrow(_pack(size, open_bins), _PLACED)
    )
    return packed.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else packed
