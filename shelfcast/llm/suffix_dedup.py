"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of ``width`` bytes repeats if it starts at two places. Comparing the
suffixes of all places would move the corpus many times over, so windows choose
anchors by their content (anchors): equal windows have equal anchors at equal
distance, and only the suffixes that begin at anchors are sorted.

1. Anchors whose next bytes (those that all their windows hold) occur once are
   dropped by a count of 64-bit hashes. Of the others, those that agree in all
   bytes of all their windows are one class, of which one is sent, with a mark
   that there are more.
2. Tasks cut these suffixes from the texts and sort them into runs. A run is
   dealt to owners of ranges, at cut points from a sample, front-coded.
3. An owner merges its runs by a tree of losers that never compares a known
   prefix again. Neighbours that share enough form a cluster; with the lengths
   of their common prefixes, and of the bytes that agree before the anchors,
   each class learns which of its windows stand elsewhere.
4. Every place of a class takes the answer; the spans of a text are united, cut
   out and the rest is hashed.

A cluster of more than HOT classes would fill one task. Its classes send the
16-byte digest of each of their windows instead, which are counted: linear in
the classes, and dealt by digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.anchors import common_bytes, find_anchors
from shelfcast.llm.hashing import slices, text_bytes
from shelfcast.llm.scratch import Scratch
from shelfcast.llm.suffix_runs import Suffix, common_prefix, decode, encode, merge

WIDTH = 400
#: Suffixes of a run, and of an owner, on average.
RUN_SUFFIXES = 1 << 14
OWNER_SUFFIXES = 1 << 15
#: Classes of a cluster that one owner resolves.
HOT = 1 << 15
#: One in so many keys lends its prefix to the sample of cut points, of which at most so many reach the driver.
SAMPLED = 64
MOST_SAMPLED = 1 << 13
#: Classes of a cluster that are compared pair by pair; larger ones are sorted by what stands before them.
_FEW = 12

_ROW = "id long, text_hash long"


def _keys(width: int):
    """The anchors' keys alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            found = find_anchors(*text_bytes(piece.column("text")), width)
            yield pa.RecordBatch.from_arrays([pa.array(found.key.view(np.int64))], names=["key"])

    return run


def _places(width: int):
    """One row an anchor, named by the digest of the bytes of all its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, bounds = text_bytes(piece.column("text"))
            found = find_anchors(data, bounds, width)
            at, view = bounds[found.doc] + found.place, memoryview(np.ascontiguousarray(data))
            key = found.key.view(np.int64)
            names = [
                # The distances are part of the name: what the windows hold does not tell them by itself.
                hashlib.blake2b(view[a - m : a - n + width], digest_size=16, salt=b"%x.%x" % (m, n)).digest()
                for a, m, n in zip(at.tolist(), found.most.tolist(), found.least.tolist())
            ]
            ahead = common_bytes(width)
            heads = [bytes(view[a : a + ahead]) if k % SAMPLED == 0 else None for a, k in zip(at.tolist(), key.tolist())]
            doc = pa.array(found.doc)
            columns = [piece.column("id").take(doc), piece.column("text_hash").take(doc)]
            columns += [pa.array(x, pa.int32()) for x in (found.place, found.least, found.most)]
            columns += [pa.array(key), pa.array(names, pa.binary()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "place", "least", "most", "key", "name", "head"])

    return run


def _suffixes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Suffix]:
    for batch in batches:
        for k in range(batch.num_rows):
            text = (batch.column("text")[k].as_py() or "").encode()
            for row in batch.column("chosen")[k].as_py():
                at = row["place"]
                ahead, behind = text[at : at - row["least"] + width], text[at - row["most"] : at][::-1]
                yield Suffix(ahead, behind, row["least"], row["many"], row["name"])


def _sorted_runs(cuts: list[bytes], width: int, run_suffixes: int):
    """(owner, run) messages: the suffixes of some texts, sorted and dealt at the cut points."""

    def pack(found: dict[bytes, Suffix]) -> Iterator[tuple[int, bytes]]:
        run = sorted(found.values(), key=lambda s: s.ahead)
        ahead, at = common_bytes(width), 0
        while at < len(run):
            owner = bisect_right(cuts, run[at].ahead[:ahead])
            to = at + 1
            while to < len(run) and (owner == len(cuts) or run[to].ahead[:ahead] < cuts[owner]):
                to += 1
            yield owner, encode(run[at:to])
            at = to

    def messages(found: dict[bytes, Suffix]) -> pa.RecordBatch:
        owners, runs = zip(*pack(found))
        return pa.RecordBatch.from_arrays([pa.array(owners, pa.int32()), pa.array(runs, pa.binary())], names=["owner", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Suffix] = {}
        for suffix in _suffixes(batches, width):
            found[suffix.name] = suffix
            if len(found) >= run_suffixes:
                yield messages(found)
                found = {}
        if found:
            yield messages(found)

    return run


def resolve(cluster: list[tuple[Suffix, int]], width: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, least distance, largest distance) of the windows of a cluster that stand elsewhere.

    ``cluster`` is sorted, each suffix with the length of the prefix it shares with the one before. A
    window at distance d stands at another place if a suffix agrees in width - d bytes ahead and d behind.
    """
    kept, names, low = [], set(), width
    for suffix, shared in cluster:
        low = min(low, shared)
        if suffix.name not in names:
            names.add(suffix.name)
            kept.append((suffix, low))
            low = width
    n = len(kept)
    least = [s.least for s, _ in kept]
    most = [len(s.behind) for s, _ in kept]
    nearest = [least[i] if s.many else width for i, (s, _) in enumerate(kept)]
    farthest = [most[i] if s.many else -1 for i, (s, _) in enumerate(kept)]
    if n <= _FEW:
        for i in range(n):
            ahead = width
            for j in range(i + 1, n):
                ahead = min(ahead, kept[j][1])
                behind = common_prefix(kept[i][0].behind, kept[j][0].behind)
                for k in (i, j):
                    near, far = max(least[k], width - ahead), min(most[k], behind)
                    if near <= far:
                        nearest[k], farthest[k] = min(nearest[k], near), max(farthest[k], far)
    else:
        _resolve_many(kept, width, np.array(least), np.array(most), nearest, farthest)
    for (suffix, _), near, far in zip(kept, nearest, farthest):
        if near <= far:
            yield suffix.name, int(near), int(far)


def _resolve_many(kept: list[tuple[Suffix, int]], width: int, least: np.ndarray, most: np.ndarray, nearest: list, farthest: list) -> None:
    """For each length of a shared prefix that occurs, the largest agreement behind among those that share it:
    it is that of neighbours in the order of what stands behind."""
    n, longest = len(kept), int(most.max())
    behind = np.zeros((n, longest + 1), np.uint8)
    for i, (suffix, _) in enumerate(kept):
        behind[i, : most[i]] = np.frombuffer(suffix.behind, np.uint8)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda i: kept[i][0].behind)] = np.arange(n)
    shared = np.array([s for _, s in kept])
    near, far = np.array(nearest), np.array(farthest)
    for length in np.unique(shared[1:])[::-1]:
        joined = shared >= length
        joined[0] = False
        group = np.cumsum(~joined)
        member = np.flatnonzero(joined | np.append(joined[1:], False))
        order = member[np.lexsort((rank[member], group[member]))]
        a, b = order[:-1], order[1:]
        agree = np.where(group[a] == group[b], _agreement(behind, a, b, np.minimum(most[a], most[b])), -1)
        best = np.full(n, -1)
        np.maximum.at(best, a, agree)
        np.maximum.at(best, b, agree)
        low, high = np.maximum(least, width - length), np.minimum(most, best)
        ok = low <= high
        near[ok], far[ok] = np.minimum(near, low)[ok], np.maximum(far, high)[ok]
    nearest[:], farthest[:] = near.tolist(), far.tolist()


def _agreement(rows: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b, ``limit`` at most; some pairs at a time."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 13):
        part = slice(at, at + (1 << 13))
        differ = rows[a[part]] != rows[b[part]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[part] = np.minimum(first, limit[part])
    return out


def _merged(width: int):
    """An owner's answers: the windows of each class that stand elsewhere."""

    def run(messages: pd.DataFrame) -> pd.DataFrame:
        enough, rows = common_bytes(width), []
        cluster: list[tuple[Suffix, int]] = []
        for suffix, shared in merge([decode(blob) for blob in messages["run"]]):
            if cluster and shared < enough:
                rows.extend(resolve(cluster, width))
                cluster = []
            cluster.append((suffix, shared))
        rows.extend(resolve(cluster, width))
        return pd.DataFrame(rows, columns=["name", "near", "far"])

    return run


def _windows(width: int):
    """One row a window of the given classes, by the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for suffix in _suffixes(batches, width):
            behind = suffix.behind[::-1]
            text, far = behind + suffix.ahead, len(behind)
            distance = range(suffix.least, far + 1)
            digests = [hashlib.blake2b(text[far - d : far - d + width], digest_size=16).digest() for d in distance]
            columns = [pa.array([suffix.name] * len(digests), pa.binary()), pa.array(distance, pa.int32())]
            columns += [pa.array([suffix.many] * len(digests)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "distance", "many", "window"])

    return run


def _counted(windows: DataFrame) -> DataFrame:
    """(name, near, far) of classes whose windows were counted."""
    windows = windows.dropDuplicates(["name", "distance"])
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many"))
    twice = twice.where((F.col("n") > 1) | F.col("many")).select("window")
    found = windows.join(twice, "window", "left_semi")
    return found.groupBy("name").agg(F.min("distance").alias("near"), F.max("distance").alias("far"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its spans."""
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            text = (batch.column("text")[k].as_py() or "").encode()
            spans: list[list[int]] = []
            for span in sorted((s["start"], s["end"]) for s in batch.column("spans")[k].as_py() or ()):
                if spans and span[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], span[1])
                else:
                    spans.append(list(span))
            edges = [0, *(x for span in spans for x in span), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(text), spans, rest))
        sizes, spans, rest = zip(*out) if out else ((), (), ())
        spans = pa.array([[{"start": a, "end": b} for a, b in of_text] for of_text in spans], _SPANS)
        columns = [batch.column("id"), pa.array(sizes, pa.int64()), spans, pa.array(rest, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "spans", "kept"])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_points(classes: DataFrame, n: int, owners: int) -> list[bytes]:
    """The prefixes at which ranges of about equally many suffixes begin, from a sample of bounded size."""
    if owners < 2:
        return []
    sampled = SAMPLED
    while n // sampled > MOST_SAMPLED // 2:
        sampled *= 2
    heads = classes.where(F.col("head").isNotNull() & (F.pmod("key", F.lit(sampled)) == 0)).select("head")
    heads = sorted(bytes(r["head"]) for r in heads.limit(4 * MOST_SAMPLED).collect())
    return sorted({heads[len(heads) * k // owners] for k in range(1, owners)}) if heads else []


def repeated_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    run_suffixes: int = RUN_SUFFIXES,
    owner_suffixes: int = OWNER_SUFFIXES,
    hot: int = HOT,
) -> DataFrame:
    """(id_col, n_bytes, spans, kept) of every row.

    ``spans`` are the stretches of bytes, in UTF-8, covered by a string of
    ``width`` bytes that also starts at another place of any text, the same one
    included; they neither touch nor overlap. ``kept`` are the remaining bytes.
    Strings never cross texts and are judged on the input.

    Texts are read whole. A class of equal suffixes (over all their windows'
    bytes) is named by a 128-bit digest; suffixes of different classes are
    compared byte by byte. A row is named by its id and a 64-bit hash of its text.

    Defined cases: a null text counts as empty, which like any text shorter
    than ``width`` has no spans. Null and repeated ids are ids like others, and
    of rows that repeat id and text each is a place of its own, so all their
    windows repeat. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    with Scratch(spark) as tmp:
        keys = source.select("text").mapInArrow(_keys(width), "key long")
        # One key may name a third of all anchors: the join reads two tables, so that it can split such a key.
        twice = tmp.write(keys.groupBy("key").count().where("count > 1").select("key"), "repeated-keys")
        places = source.mapInArrow(
            _places(width), f"{_ROW}, place int, least int, most int, key long, name binary, head binary"
        )
        places = tmp.write(places.join(twice, "key", "left_semi"), "anchors")
        classes = places.groupBy("name").agg(
            F.min(F.struct("id", "text_hash", "place")).alias("first"),
            (F.count(F.lit(1)) > 1).alias("many"),
            *(F.max(c).alias(c) for c in ("least", "most", "key", "head")),
        )
        classes = tmp.write(classes, "suffix-classes")
        crowded = classes.groupBy("key").count().where(F.col("count") > hot).select("key")
        crowded = tmp.write(crowded, "hot-prefixes")
        some_hot = not crowded.isEmpty()
        calm = classes.join(crowded, "key", "left_anti") if some_hot else classes
        n = classes.count()
        cuts = _cut_points(calm, n, -(-n // owner_suffixes))
        sent = _with_texts(source, calm).mapInArrow(_sorted_runs(cuts, width, run_suffixes), "owner int, run binary")
        answers = sent.groupBy("owner").applyInPandas(_merged(width), "name binary, near int, far int")
        if some_hot:
            busy = _with_texts(source, classes.join(crowded, "key", "left_semi"))
            schema = "name binary, distance int, many boolean, window binary"
            windows = tmp.write(busy.mapInArrow(_windows(width), schema), "windows")
            answers = answers.unionByName(_counted(windows))
        answers = tmp.write(answers, "repeated-windows")
        span = F.struct(
            (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + F.lit(width)).alias("end")
        )
        spans = places.join(answers, "name").groupBy("id", "text_hash").agg(F.collect_set(span).alias("spans"))
        cut = _same_row(source, spans, "left").select("id", "text", "spans")
        out = cut.mapInArrow(_cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
        return tmp.write(out, "suffix-dedup", keep=True).withColumnRenamed("id", id_col)


def _same_row(source: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = rows.withColumnsRenamed({"id": "row_id", "text_hash": "row_hash"})
    return source.join(rows, source["id"].eqNullSafe(rows["row_id"]) & (source["text_hash"] == rows["row_hash"]), how)


def _with_texts(source: DataFrame, classes: DataFrame) -> DataFrame:
    """(text, chosen): the texts that lend classes their first suffix, with these."""
    chosen = classes.groupBy(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash")).agg(
        F.collect_list(F.struct("first.place", "least", "most", "many", "name")).alias("chosen")
    )
    return _same_row(source, chosen, "inner").select("text", "chosen")
