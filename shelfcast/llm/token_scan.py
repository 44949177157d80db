"""Token counts of documents in flat token files, by a scan for the end-of-document id.

A token file is one stream of ids, cut into blocks of equal size without
regard to documents and without an index of positions. Blocks are scanned in
parallel and on their own; what a block needs to know of those before it (where
it starts, how many documents have ended, where the last of them ended) comes
from prefix scans over one small row per block, first within runs of blocks,
then over the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.hashing import slices
from shelfcast.llm.tokens import cached_encoder

BLOCK_TOKENS = 1 << 20
#: Blocks in a run of the prefix scan.
RUN_BLOCKS = 1024
FILE_SCHEMA = "file long, block long, tokens binary, doc_ids array<long>"
_SCAN = "file long, block long, n long, ends array<int>, doc_ids array<long>"


def token_files(
    docs: DataFrame, make_encoder, *args: str, end_id: int, block: int = BLOCK_TOKENS, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Flat token files of the documents: (file, block, tokens, doc_ids).

    A task writes one file. ``tokens`` are little-endian unsigned 16-bit ids
    (32-bit where ``end_id`` needs it), each document's followed by ``end_id``;
    ``doc_ids`` names, in order, the documents that end in the block. The frame
    is to be written before it is used twice: a file is what one task wrote.
    """
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached_encoder(make_encoder, *args)
        context = pyspark.TaskContext.get()
        file = context.partitionId() if context else 0
        number, rest, ended, ended_at, written = 0, [], [], [], 0

        def cut(last: bool):
            """Blocks that are full (at the end: all that is left)."""
            nonlocal number, rest, ended, ended_at, written
            stream = np.concatenate(rest) if rest else np.empty(0, kind)
            full = -(-len(stream) // block) if last else len(stream) // block
            for k in range(full):
                part = stream[k * block : (k + 1) * block]
                top = written + len(part)
                n = int(np.searchsorted(ended_at, top, "right")) if ended_at else 0
                names, ended, ended_at = ended[:n], ended[n:], ended_at[n:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([part.tobytes()], pa.binary()),
                     pa.array([names], pa.list_(pa.int64()))],
                    names=["file", "block", "tokens", "doc_ids"],
                )
                number, written = number + 1, top
            rest = [stream[full * block :]]

        total = 0
        for piece in slices(batches, "text", 8 << 20):
            ids, bounds = encoder.column(piece.column("text"))
            stream = np.insert(ids, bounds[1:], end_id).astype(kind)
            rest.append(stream)
            ended.extend(piece.column("id").to_pylist())
            ended_at.extend((total + bounds[1:] + np.arange(1, piece.num_rows + 1)).tolist())
            total += len(stream)
            yield from cut(last=False)
        yield from cut(last=True)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, FILE_SCHEMA)


def scan_blocks(files: DataFrame, end_id: int) -> DataFrame:
    """Of each block: its number of ids, and the places of ``end_id`` in it."""
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                tokens = np.frombuffer(part.column("tokens")[0].as_buffer() if part.column("tokens")[0].is_valid else b"", kind)
                ends = np.flatnonzero(tokens == end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("file"), part.column("block"), pa.array([len(tokens)], pa.int64()),
                     pa.array([ends], pa.list_(pa.int32())), part.column("doc_ids")],
                    names=["file", "block", "n", "ends", "doc_ids"],
                )

    return files.select("file", "block", "tokens", "doc_ids").mapInArrow(run, _SCAN)


def token_counts(files: DataFrame, end_id: int, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """One row per document: (file, ordinal, doc_id, start, n_tokens, terminated).

    ``start`` is the document's first id in its file, ``n_tokens`` counts its
    ids without the end id. Ids after a file's last end id are one more
    document with ``terminated`` false and a null doc_id.

    Defined cases: two end ids in a row bound an empty document; a document may
    span any number of blocks; a null or empty block holds nothing; a table
    without blocks gives no rows. Other columns are not read.
    """
    scanned = scan_blocks(files, end_id).withColumns(
        {
            "run": F.floor(F.col("block") / run_blocks),
            "n_ends": F.size("ends").cast("long"),
            "last": F.when(F.size("ends") > 0, F.element_at("ends", -1).cast("long")),
        }
    )
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run_order = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = scanned.withColumn("at", F.coalesce(F.sum("n").over(in_run), zero)).withColumns(
        {
            "ended": F.coalesce(F.sum("n_ends").over(in_run), zero),
            "last_end": F.max(F.col("at") + F.col("last")).over(in_run),
        }
    )
    runs = local.groupBy("file", "run").agg(
        F.sum("n").alias("run_n"), F.sum("n_ends").alias("run_ends"), F.max(F.col("at") + F.col("last")).alias("run_last")
    )
    runs = runs.withColumn("run_at", F.coalesce(F.sum("run_n").over(run_order), zero)).withColumns(
        {
            "run_ended": F.coalesce(F.sum("run_ends").over(run_order), zero),
            "run_last_end": F.max(F.col("run_at") + F.col("run_last")).over(run_order),
        }
    )
    placed = local.join(runs.select("file", "run", "run_at", "run_ended", "run_last_end"), ["file", "run"])
    placed = placed.select(
        "file", "block", "doc_ids", "ends",
        (F.col("run_at") + F.col("at")).alias("at"),
        (F.col("run_ended") + F.col("ended")).alias("ended"),
        F.coalesce(F.col("run_at") + F.col("last_end"), F.col("run_last_end"), F.lit(-1)).alias("open_after"),
        F.col("n"),
    )
    docs = placed.select("*", F.posexplode("ends").alias("k", "end")).select(
        "file",
        (F.col("ended") + F.col("k")).alias("ordinal"),
        F.get("doc_ids", F.col("k")).alias("doc_id"),
        F.when(F.col("k") > 0, F.col("at") + F.get("ends", F.col("k") - 1) + 1)
        .otherwise(F.col("open_after") + 1)
        .alias("start"),
        (F.col("at") + F.col("end")).alias("stop"),
        F.lit(True).alias("terminated"),
    )
    tails = placed.groupBy("file").agg(
        F.max(F.col("ended") + F.size("ends")).alias("ordinal"),
        F.max(F.col("at") + F.col("n")).alias("stop"),
        F.max(F.coalesce(F.col("at") + F.get("ends", F.size("ends") - 1), F.col("open_after"))).alias("after"),
    )
    tails = tails.where("stop > after + 1").select(
        "file", F.col("ordinal").cast("long").alias("ordinal"), F.lit(None).cast("long").alias("doc_id"),
        (F.col("after") + 1).alias("start"), "stop", F.lit(False).alias("terminated"),
    )
    out = docs.unionByName(tails)
    return out.select("file", "ordinal", "doc_id", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "terminated")
