"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Rows are dealt into blocks by a hash of their id. A block sends each owner of
a fingerprint range the sorted, Golomb-coded fingerprints that fall there, each
once, with a bit for those that it has more than once itself, so an owner gets
the copies of one text at most once a block, however many there are. The
owner answers with one bit for each: met more than once or not. Only rows with
that bit (true copies, and about one row in 2**SLACK_BITS by chance) are
suspects, whose texts are then shuffled and compared byte by byte. The
fingerprint is only as long as the number of rows asks for, so an exchange
costs about SLACK_BITS + 2 bits a row. Blocks and owners grow together, with the
root of the number of rows, so a message holds as many fingerprints at any size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm import golomb
from shelfcast.llm.hashing import slices
from shelfcast.llm.scratch import Scratch

SLACK_BITS = 12
#: Rows that make a block, and that an owner answers for, at least, on average.
BLOCK_ROWS = 1 << 13
#: Fingerprints of a message, on average, where blocks are larger than that.
MESSAGE_ROWS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sha) with the SHA-256 of each text, lower-cased in A-Z only."""
    for piece in slices(batches, "text", 4 << 20):
        texts = pc.fill_null(piece.column("text"), "").cast(pa.binary())
        shas = [hashlib.sha256(t.as_py().lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(shas, pa.binary())], names=["id", "sha"])


def _fingerprints(shas: pd.Series, span: int) -> np.ndarray:
    """Uniform values below span, a power of two, from the first 8 bytes of each digest."""
    first = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
    return first & np.uint64(span - 1)


def shares(n: int) -> tuple[int, int]:
    """(blocks, owners) for n rows; owners is a power of two."""
    rows = max(BLOCK_ROWS, math.isqrt(MESSAGE_ROWS * max(n, 1)))
    return max(4, n // rows), 1 << max(2, (n // rows).bit_length())


def _send(span: int, owners: int):
    """A block's messages: a sorted, coded list of fingerprints for each owner, and the bits of those repeated here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints, counts = np.unique(_fingerprints(pdf["sha"], span), return_counts=True)
        width = span // owners
        cuts = np.searchsorted(prints, np.arange(1, owners, dtype=np.uint64) * np.uint64(width))
        rows = []
        for owner, (part, n) in enumerate(zip(np.split(prints, cuts), np.split(counts, cuts))):
            if len(part):
                code = golomb.encode(part - np.uint64(owner * width), width)
                rows.append((owner, int(pdf["block"].iloc[0]), code, np.packbits(n > 1).tobytes()))
        return pd.DataFrame(rows, columns=["owner", "block", "prints", "repeated"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's replies: for each message one bit a fingerprint, set if it was met more than once."""
    lists = [golomb.decode(x) for x in pdf["prints"]]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(x)].astype(bool) for b, x in zip(pdf["repeated"], lists)]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = np.union1d(values[counts > 1], np.concatenate([x[b] for x, b in zip(lists, bits)]))
    marks = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"block": pdf["block"], "owner": pdf["owner"], "marks": marks})


def _suspects(span: int, owners: int):
    """The rows of a block whose bit is set."""

    def run(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows[["id", "sha"]]
        prints, print_of = np.unique(_fingerprints(rows["sha"], span), return_inverse=True)
        owner_of = (prints // np.uint64(span // owners)).astype(np.int64)
        marked = np.zeros(len(prints), bool)
        for owner, marks in zip(replies["owner"], replies["marks"]):
            at = np.searchsorted(owner_of, [owner, owner + 1])
            marked[at[0] : at[1]] = np.unpackbits(np.frombuffer(marks, np.uint8))[: at[1] - at[0]]
        return rows.loc[marked[print_of], ["id", "sha"]]

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. Of equal texts the row with the largest id stays; group_size counts
    their rows, text_sha256 is of the normalised text in UTF-8.

    Defined cases: of rows that repeat both id and text, one stays. A null id
    ranks below all others and names a group only if all its ids are null.
    Other columns are not read, so their names cannot clash. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as tmp:
        # The serial number is generated once, in a written table, so it is fixed from here on.
        rows = source.mapInArrow(_digests, "id long, sha binary")
        rows = tmp.write(rows.withColumn("serial", F.monotonically_increasing_id()), "digests")
        n = rows.count()
        span = 1 << max(8, (max(n, 1) - 1).bit_length() + SLACK_BITS)
        blocks, owners = shares(n)
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)))
        sent = dealt.groupBy("block").applyInPandas(_send(span, owners), "owner long, block long, prints binary, repeated binary")
        replies = sent.groupBy("owner").applyInPandas(_answer, "block long, owner long, marks binary")
        suspects = (
            dealt.groupBy("block")
            .cogroup(replies.groupBy("block"))
            .applyInPandas(_suspects(span, owners), "id long, sha binary")
        )
        suspects = tmp.write(suspects, "suspects")
        groups = tmp.write(_verified(source, suspects), "groups")

        # The copies of one text may be a third of all rows: both sides are tables, which a skewed join can split.
        marked = rows.join(groups, "sha", "left")
        out = marked.select(
            F.col("id").alias(id_col),
            F.coalesce("keep_id", "id").alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.col("id").eqNullSafe(F.coalesce("keep_id", "id")).alias("top"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        # Rows of a window are equal in every column, so any order gives the same result.
        same_row = Window.partitionBy("text_sha256", "keep_id").orderBy(F.lit(1))
        top = out.where("top").withColumn("kept", F.row_number().over(same_row) == 1)
        rest = out.where("not top").withColumn("kept", F.lit(False))
        return tmp.write(top.unionByName(rest).drop("top"), "exact-dedup", keep=True)



def _verified(source: DataFrame, suspects: DataFrame) -> DataFrame:
    """(sha, keep_id, size) of the texts that several suspects share, compared by their bytes.

    Copies combine before the shuffle, on the whole normalised text.
    """
    ids = suspects.select("id").distinct()
    known = source.where("id is not null").join(ids, "id", "left_semi")
    if not suspects.where("id is null").isEmpty():
        known = known.unionByName(source.where("id is null"))
    normal = known.select("id", F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER).alias("text"))
    same = normal.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    return same.where("size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "size")


def without_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``found``, the result of exact_dedup, keeps; all columns stay.

    Defined cases: of rows that repeat both id and text one stays, whichever
    its other columns; a null id is like any other value.
    """
    kept = found.where("kept").groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    kept = kept.agg(F.max(F.lit(1)).alias("__one"))
    repeated = found.groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).agg(F.count(F.lit(1)).alias("__n"))
    normal = F.translate(F.coalesce(docs[text_col].cast("string"), F.lit("")), _UPPER, _LOWER)
    marked = docs.withColumn("__text", F.sha2(normal, 256))
    same = marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha"))
    out = marked.join(kept, same, "left_semi")
    twice = repeated.where("__n > 1")
    if not twice.isEmpty():
        again = out.join(twice, same, "left_semi").dropDuplicates([id_col, "__text"])
        out = out.join(twice, same, "left_anti").unionByName(again)
    return out.select(*docs.columns)
