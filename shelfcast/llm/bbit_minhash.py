"""b-bit MinHash: sketches, band candidates, and links verified on full texts.

A document's (or paragraph's) set of shingle hashes is reduced to ``K`` minima
under independent hash functions. Band keys are hashes of ``rows`` consecutive
minima; of each minimum itself only the low ``BITS`` bits are retained, packed
as bit planes, so that two sketches compare by XOR, OR and bit counts in the
JVM. The share of equal values is corrected for chance agreement (2**-BITS).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import hashing
from shelfcast.llm.components import connected_components
from shelfcast.llm.scratch import Scratch

BITS = 4
#: Values of the finer sketch, and five standard deviations of its estimate at 0.8.
FINE = 1024
FINE_MARGIN = 0.068


@dataclass(frozen=True)
class Banding:
    """``bands`` keys of ``rows`` minima each; ``k`` minima in all, a multiple of 64.

    A pair of Jaccard similarity s shares a key with probability 1 - (1 - s**rows)**bands.
    """

    rows: int
    bands: int
    k: int

    def miss(self, similarity: float) -> float:
        return (1 - similarity**self.rows) ** self.bands


class Sketcher:
    """Minima, band keys and packed low bits of sets of 64-bit hashes."""

    def __init__(self, banding: Banding):
        self.banding = banding
        rng = np.random.default_rng(20_240_601)
        self.a = (rng.integers(0, 1 << 32, banding.k, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, banding.k, dtype=np.uint64).astype(np.uint32)[:, None]
        self.band_salt = rng.integers(0, 1 << 63, banding.bands, dtype=np.uint64)

    def minima(self, items: np.ndarray) -> np.ndarray:
        """k minima of a non-empty array of mixed 64-bit hashes."""
        h = (items >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.banding.k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 4096):
            np.minimum(out, (self.a * h[None, at : at + 4096] + self.b).min(axis=1), out=out)
        return out

    def keys_and_bits(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of an (n, k) array: (n, bands) int64 keys and (n, BITS * k / 64) int64 bit planes."""
        n, p = len(minima), self.banding
        mixed = hashing.mix64(minima.astype(np.uint64) + (np.arange(p.k, dtype=np.uint64) << np.uint64(32)))
        keys = np.zeros((n, p.bands), np.uint64) + self.band_salt
        used = mixed[:, : p.rows * p.bands].reshape(n, p.bands, p.rows)
        for r in range(p.rows):
            keys = hashing.mix64(keys ^ used[:, :, r])
        planes = [np.packbits((mixed >> np.uint64(j)).astype(np.uint8) & 1, axis=1) for j in range(BITS)]
        bits = np.concatenate(planes, axis=1) if n else np.empty((0, BITS * p.k // 8), np.uint8)
        return keys.view(np.int64), np.ascontiguousarray(bits).view(np.int64)


def estimated_similarity(x: Column, y: Column, k: int) -> Column:
    """Jaccard similarity of two packed sketches, corrected for chance agreement."""
    words = k // 64
    differ = None
    for w in range(words):
        planes = [x[j * words + w].bitwiseXOR(y[j * words + w]) for j in range(BITS)]
        any_bit = planes[0]
        for p in planes[1:]:
            any_bit = any_bit.bitwiseOR(p)
        differ = F.bit_count(any_bit) if differ is None else differ + F.bit_count(any_bit)
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(k))) - chance) / (1 - chance)


def verified_links(pairs: DataFrame, texts: DataFrame, confirm: Callable) -> DataFrame:
    """The pairs (u, v) whose texts ``confirm`` accepts. A node that many pairs
    share meets them in a plain equi-join, which adaptive execution can split."""
    one = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    two = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    both = pairs.join(one, "v").join(two, "u")
    return both.where(confirm("text_u", "text_v")).select("u", "v").distinct()


def link_components(
    classes: DataFrame,
    banding: Banding,
    floor: float,
    texts: Callable[[DataFrame], DataFrame],
    width: int,
    least: int,
    cell: int = 1024,
) -> DataFrame:
    """(id, component) of the nodes that are linked with another.

    ``classes`` is a written table (node, n, bits, keys), one row per distinct
    set of n shingles of ``width`` words; ``texts`` gives (node, text) for a
    frame of nodes. Linked are sets with 100 * |A & B| >= least * |A | B|. Pairs
    whose estimate is under ``floor`` (well under that) are not confirmed.

    First every member of a bucket is tested against the bucket's smallest
    node. Buckets that then hold several components stay open, and only pairs
    of nodes in different components are tested further (those inside one
    change no component): against the bucket's most central node, then, in
    cells of about ``cell`` members a side, all others, each pair in the first
    bucket that its nodes share.

    In a large group of copies with many edits each, many nodes end alone, and
    testing all their pairs would grow with its square. Two things spare that.
    Shingles that only one node of the open buckets has are in no
    intersection, so |A & B| is at most the smaller count of the others: nodes
    and pairs that cannot reach ``least`` by this exact bound are left out.
    And open nodes get a finer sketch of ``FINE`` values, whose estimate may
    miss by ``FINE_MARGIN``, five standard deviations, before a pair is left out.
    """
    confirm = jaccard_confirm(width, least, 100)
    spark = classes.sparkSession
    with Scratch(spark) as tmp:
        exploded = classes.select("node", F.explode("keys").alias("key"))
        buckets = tmp.write(
            exploded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"),
            "buckets",
        )
        members = tmp.write(exploded.join(buckets, "key"), "members")
        bits = classes.select("node", "bits")
        shared = tmp.write(texts(members.select("node").distinct()), "texts")

        star = members.where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
        star = tmp.write(star, "star")
        first = star.join(bits.select(F.col("node").alias("v"), F.col("bits").alias("bits_v")), "v").join(
            bits.select(F.col("node").alias("u"), F.col("bits").alias("bits_u")), "u"
        )
        first = first.where(estimated_similarity(F.col("bits_u"), F.col("bits_v"), banding.k) >= floor)
        links = tmp.write(verified_links(first.select("u", "v"), shared, confirm), "links")
        found = connected_components(links, "u", "v")

        unsettled = tmp.write(_open_buckets(members, found), "unsettled")
        if unsettled.isEmpty():
            return found
        owned = tmp.write(shared.join(unsettled.select("node").distinct(), "node", "left_semi"), "owned")
        single = owned.mapInArrow(_items(width), "node long, item long").groupBy("item")
        single = single.agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
        single = tmp.write(single.groupBy("node").agg(F.count(F.lit(1)).alias("own_items")), "single")
        fine = owned.mapInArrow(_fine_bits(width), "node long, bits array<long>")
        sized = classes.select("node", "keys", F.col("n").alias("items")).join(single, "node", "left")
        sized = sized.withColumn("common", F.col("items") - F.coalesce("own_items", F.lit(0)))
        sized = sized.where(F.col("common") * 100 >= F.col("items") * least)
        sized = tmp.write(sized.select("node", "keys", "items", "common").join(fine, "node"), "sized")

        # The most central node shares most with the others, so it settles most of a bucket.
        weighed = unsettled.join(sized.select("node", "items", "common"), "node")
        weighed = tmp.write(weighed, "weighed")
        centres = weighed.groupBy("key").agg(
            F.min(F.struct((-F.col("common")).alias("rank"), "node", "component", "items", "common")).alias("hub")
        )
        centres = tmp.write(centres, "centres")
        x, y = weighed.join(centres, "key"), F.col("hub")
        reach = F.least(F.col("common"), y["common"])
        near = x.where((F.col("component") != y["component"]) & (reach * 100 >= (F.col("items") + y["items"] - reach) * least))
        near = near.select(F.least("node", y["node"]).alias("u"), F.greatest("node", y["node"]).alias("v")).distinct()
        near = tmp.write(near.join(star, ["u", "v"], "left_anti"), "near")
        links = tmp.write(links.unionByName(verified_links(near, shared, confirm)), "links")
        found = connected_components(links, "u", "v")

        rest = _open_buckets(members, found).join(sized, "node")
        cells = F.ceil(F.col("n") / cell).cast("long")
        rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), cells))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
        rest = tmp.write(
            rest.select(
                "key", "node", "component", "keys", "bits", "items", "common", "own",
                F.least("own", "other").alias("cell_a"), F.greatest("own", "other").alias("cell_b"),
            ),
            "rest",
        )
        x, y = rest.alias("x"), rest.alias("y")
        reach = F.least("x.common", "y.common")
        same_cell = (
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.cell_a") == F.col("y.cell_a"))
            & (F.col("x.cell_b") == F.col("y.cell_b"))
        )
        shared_at = F.array_position(F.zip_with("x.keys", "y.keys", lambda a, b: a == b), True)
        pairs = x.join(
            y,
            same_cell
            & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("x.cell_a") == F.col("x.cell_b")) | (F.col("x.own") != F.col("y.own")))
            & (reach * 100 >= (F.col("x.items") + F.col("y.items") - reach) * least)
            & (estimated_similarity(F.col("x.bits"), F.col("y.bits"), FINE) >= least / 100 - FINE_MARGIN)
            & (F.element_at("x.keys", shared_at.cast("int")) == F.col("x.key")),
        ).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        pairs = pairs.distinct().join(star.unionByName(near), ["u", "v"], "left_anti")
        more = tmp.write(verified_links(pairs, shared, confirm), "more")
        if more.isEmpty():
            return found
        return connected_components(links.unionByName(more), "u", "v")


def _open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, component, n) of the buckets of more than two nodes that hold several components."""
    placed = members.where("size > 2").join(found.withColumnRenamed("id", "node"), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return placed.select("key", "node", "component").join(split.where("low != high").select("key", "n"), "key")


def _fine_bits(width: int):
    """(node, bits) with a sketch of FINE values of each node's text."""

    def run(batches):
        sketcher = Sketcher(Banding(rows=1, bands=1, k=FINE))
        for piece in hashing.slices(batches, "text"):
            sets = [shingle_set((t or "").encode(), width) for t in piece.column("text").to_pylist()]
            minima = [sketcher.minima(x) if len(x) else np.zeros(FINE, np.uint32) for x in sets]
            _, bits = sketcher.keys_and_bits(np.array(minima, np.uint32).reshape(len(sets), FINE))
            yield pa.RecordBatch.from_arrays(
                [piece.column("node"), pa.array(list(bits), pa.list_(pa.int64()))], names=["node", "bits"]
            )

    return run


def _items(width: int):
    """(node, item) for every shingle of each node's text."""

    def run(batches):
        for piece in hashing.slices(batches, "text"):
            data, bounds = hashing.text_bytes(piece.column("text"))
            words, first = hashing.word_hashes(data, bounds)
            sets = [np.unique(hashing.shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1], first[1:])]
            own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [piece.column("node").take(pa.array(own)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "item"]
            )

    return run


def jaccard_confirm(width: int, least: int, of: int):
    """An exact test of two text columns: of * intersection >= least * union of
    their sets of ``width``-word shingles. Sets are taken from the whole texts."""

    @F.pandas_udf("boolean")
    def confirm(one: pd.Series, two: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def items(text: str) -> np.ndarray:
            if text not in known:
                if len(known) > 256:
                    known.clear()
                known[text] = shingle_set(text.encode(), width)
            return known[text]

        out = []
        for a, b in zip(one, two):
            s, t = items(a or ""), items(b or "")
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both > 0 and of * both >= least * (len(s) + len(t) - both))
        return pd.Series(out, dtype=bool)

    return confirm


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    raw = np.frombuffer(data, np.uint8)
    words, _ = hashing.word_hashes(raw, np.array([0, len(raw)], np.int64))
    return np.unique(hashing.shingle_hashes(words, width))


def set_digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes, whatever its order."""
    with np.errstate(over="ignore"):
        one = hashing.mix64(items).sum(dtype=np.uint64)
        two = hashing.mix64(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return tuple(np.array([one, two], np.uint64).view(np.int64).tolist())
