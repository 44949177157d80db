"""MinHash near-duplicate detection of documents (b-bit sketches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import hashing, held
from shelfcast.llm.bbit_minhash import Banding, Sketcher, link_components, set_digest
from shelfcast.llm.components import connected_components
from shelfcast.llm.scratch import Scratch

#: At similarity 0.8 a pair is missed with probability 5e-5, at 0.85 with 4e-7.
BANDING = Banding(rows=5, bands=25, k=128)
#: The estimate from 128 values has a standard deviation of at most 0.05.
MARGIN = 0.22
_SCHEMA = "id long, tie long, n_shingles long, h1 long, h2 long, keys array<long>, bits array<long>"


def sketch_table(docs: DataFrame, id_col: str, text_col: str, width: int, banding: Banding) -> DataFrame:
    """(id, tie, n_shingles, h1, h2, keys, bits) of every row; keys and bits are null for an empty set.

    ``tie`` is a hash of the text, which tells rows that repeat an id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.release()
        sketcher = Sketcher(banding)
        for piece in hashing.slices(batches, "text"):
            data, bounds = hashing.text_bytes(piece.column("text"))
            words, first = hashing.word_hashes(data, bounds)
            n, named, minima, rows = [], [], [], []
            for i in range(piece.num_rows):
                items = np.unique(hashing.shingle_hashes(words[first[i] : first[i + 1]], width))
                n.append(len(items))
                named.append(set_digest(items) if len(items) else (None, None))
                if len(items):
                    rows.append(i)
                    minima.append(sketcher.minima(items))
            stacked = np.array(minima, np.uint32).reshape(len(rows), banding.k)
            keys, bits = sketcher.keys_and_bits(stacked)
            lists = {name: [None] * piece.num_rows for name in ("keys", "bits")}
            for at, i in enumerate(rows):
                lists["keys"][i], lists["bits"][i] = keys[at], bits[at]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    piece.column("tie"),
                    pa.array(n, pa.int64()),
                    pa.array([x[0] for x in named], pa.int64()),
                    pa.array([x[1] for x in named], pa.int64()),
                    pa.array(lists["keys"], pa.list_(pa.int64())),
                    pa.array(lists["bits"], pa.list_(pa.int64())),
                ],
                names=["id", "tie", "n_shingles", "h1", "h2", "keys", "bits"],
            )

    return _source(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.withColumn("tie", F.xxhash64("text"))


def minhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    least: int = 80,
    banding: Banding = BANDING,
) -> DataFrame:
    """Near-duplicate groups: (id_col, n_shingles, component_id, kept).

    Two documents are linked when 100 * |A & B| >= least * |A | B| for their
    sets of distinct ``width``-word shingles (a shorter text is one shingle),
    confirmed on the full sets. ``component_id`` is the smallest id reachable
    over links, ``kept`` marks the document that bears it.

    Defined cases: a null or wordless text has an empty set and is linked with
    nothing. Equal sets are one class and are linked. Rows that repeat an id
    are the same document: they share a component and are all marked alike.
    Rows with a null id get a null component and are kept. Other columns are
    not read, so their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark) as tmp:
        table = tmp.write(sketch_table(docs, id_col, text_col, width, banding), "sketches")
        known = table.where("id is not null and n_shingles > 0")
        classes = known.groupBy("h1", "h2").agg(
            F.min(F.struct("id", "tie")).alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")
        )
        # The node id is generated once, in a written table, so it is fixed from here on.
        classes = tmp.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

        def texts(nodes: DataFrame) -> DataFrame:
            reps = classes.join(nodes, "node", "left_semi").select("node", "rep.id", "rep.tie")
            same = _source(docs, id_col, text_col).join(reps, ["id", "tie"])
            return same.groupBy("node").agg(F.first("text").alias("text"))

        sets = classes.select("node", "n", "keys", "bits")
        found = link_components(sets, banding, least / 100 - MARGIN, texts, width, least)
        # A repeated id may stand in several classes: those are one document, so ids are joined up too.
        own = known.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("rows"))
        named = classes.select("h1", "h2", "node", F.col("rep.id").alias("rep")).join(found.withColumnRenamed("id", "node"), "node", "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
        lows = tmp.write(named.groupBy("component").agg(F.min("rep").alias("low")), "lows")
        named = tmp.write(named.join(lows, "component").select("h1", "h2", "low"), "named")
        ids = tmp.write(own.join(named, ["h1", "h2"]).groupBy("id").agg(F.min("low").alias("low"), F.max("low").alias("high")), "ids")
        clash = ids.where("low != high")
        if not clash.isEmpty():
            merged = connected_lows(own.join(named, ["h1", "h2"]).select("id", "low"))
            ids = ids.join(merged, "low", "left").select("id", F.coalesce("to", "low").alias("low"))
        rows = table.select("id", "n_shingles").join(ids.select("id", "low"), "id", "left")
        component = F.coalesce("low", "id")
        out = rows.select(
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
        return tmp.write(out, "minhash-dedup", keep=True)


def connected_lows(pairs: DataFrame) -> DataFrame:
    """(low, to): components of labels that share an id, named by the smallest label."""
    hub = pairs.groupBy("id").agg(F.min("low").alias("least"))
    edges = pairs.join(hub, "id").select("low", "least")
    return connected_components(edges, "low", "least").select(F.col("id").alias("low"), F.col("component").alias("to"))
