"""Ranked lexical search of many queries at once, with their common sums shared.

All queries of a block are evaluated in one pass over the documents. First a
pass reduces each document to its length and the frequencies of the terms that
some query holds; document frequencies come from that table. Then the shared
term sets of the queries (query_sharing) are laid out as a graph: for some
documents at a time, each leaf's accumulator is filled from the frequencies,
each node adds up two others once, and each query sums its nodes. A task keeps
the best of every query it has met; only these are shuffled and ranked.

Everything but a term's weight is integer arithmetic, so scores don't depend on
the order of sums or on how the documents are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from shelfcast.llm.hashing import segment_hashes, slices, text_bytes
from shelfcast.llm.query_sharing import SharingPlan, share
from shelfcast.llm.scratch import Scratch

#: A block of queries closes at so many queries, or distinct terms; what a task holds is bounded by both.
BLOCK_QUERIES = 512
BLOCK_TERMS = 1 << 16
#: Accumulators (nodes times documents) that a task holds at a time, 8 bytes each.
_CELLS = 1 << 22
_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_low : _high + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts, and each text's first term (n + 1 values).

    A term is a longest run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    """
    data, bounds = text_bytes(column)
    data = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = _TERM[data]
    goes_on = inside[1:] & inside[:-1] & ~edge[1:-1] if len(data) else np.empty(0, bool)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], goes_on])[: len(data)])
    ends = np.flatnonzero(inside & ~np.concatenate([goes_on, [False]])[: len(data)]) + 1
    return segment_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def _frequencies(known: np.ndarray):
    """(id, n, terms, tfs): a document's number of terms, and the places in ``known`` (sorted
    hashes) of those that occur in it, with how often they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            hashes, first = term_hashes(piece.column("text"))
            place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            found = np.flatnonzero(known[place] == hashes)
            doc = np.searchsorted(first, found, "right") - 1
            cells, tfs = np.unique(doc * len(known) + place[found], return_counts=True)
            doc, terms = np.divmod(cells, len(known))
            bounds = pa.array(np.searchsorted(doc, np.arange(piece.num_rows + 1)), pa.int32())
            columns = [
                piece.column("id"),
                pa.array(np.diff(first), pa.int64()),
                pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(tfs, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])

    return run


class _Scorer:
    """Scores of all queries for some documents at a time, along the sharing graph."""

    def __init__(self, plan: SharingPlan, weights: np.ndarray, n_docs: int, n_terms: int):
        self.plan, self.weights, self.n_docs, self.n_terms = plan, weights, n_docs, n_terms
        literals = sorted((term, leaf, count) for leaf, of in enumerate(plan.leaves) for term, count in of)
        self.term, self.leaf, self.count = np.array(literals, np.int64).reshape(-1, 3).T
        self.nodes = len(plan.leaves) + len(plan.sums)
        self.step = max(1, _CELLS // max(1, self.nodes + len(plan.queries)))

    def scores(self, n: np.ndarray, doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """(query, document) scores; ``doc``, ``terms`` and ``tfs`` are the frequencies, one by one."""
        length = 100 - 25 + (25 * n * self.n_docs) // max(1, self.n_terms)
        part = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * length[doc]))
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        times = high - low
        row = np.repeat(np.arange(len(terms)), times)
        literal = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row]
        sums = np.zeros((self.nodes, len(n)), np.int64)
        np.add.at(sums, (self.leaf[literal], doc[row]), part[row] * self.count[literal])
        for node, (a, b) in enumerate(self.plan.sums, len(self.plan.leaves)):
            np.add(sums[a], sums[b], out=sums[node])
        out = np.zeros((len(self.plan.queries), len(n)), np.int64)
        for q, nodes in enumerate(self.plan.queries):
            for node in nodes:
                out[q] += sums[node]
        return out


class _Best:
    """The k best of each query so far; equal scores by ascending id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.ones(queries, np.int64)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * queries

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, doc = np.nonzero(scores >= self.least[:, None])
        for q, at in zip(*_runs_of(query)):
            found = (scores[q, doc[at]], ids[doc[at]], null[doc[at]])
            score, number, none = (np.concatenate(x) for x in zip(self.rows[q], found))
            best = np.lexsort((number, none, -score))[: self.k]
            self.rows[q] = score[best], number[best], none[best]
            if len(best) == self.k:
                self.least[q] = score[best[-1]]


def _runs_of(sorted_keys: np.ndarray):
    """Each key of a sorted array once, and the slices where they stand."""
    keys, at = np.unique(sorted_keys, return_index=True)
    return keys, [slice(a, b) for a, b in zip(at, [*at[1:], len(sorted_keys)])]


def _best_of_task(scorer: _Scorer, k: int):
    """(query, doc_id, score) of the k best documents of each query in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(scorer.plan.queries), k)
        for batch in batches:
            for at in range(0, batch.num_rows, scorer.step):
                part = batch.slice(at, scorer.step)
                ids, terms = part.column("id"), part.column("terms")
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                flat = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (terms, part.column("tfs")))
                scores = scorer.scores(part.column("n").to_numpy(zero_copy_only=False), doc, *flat)
                best.add(scores, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False))
        for q, (score, number, none) in enumerate(best.rows):
            if len(score):
                columns = [pa.array(np.full(len(score), q), pa.int64()), pa.array(number, pa.int64(), mask=none), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, most_queries: int, most_terms: int) -> Iterator[list[tuple[Row, np.ndarray]]]:
    """The queries with the hashes of their terms, in blocks of bounded size; a longer one stands alone."""
    block: list[tuple[Row, np.ndarray]] = []
    room = most_terms
    for row in items.toLocalIterator():
        hashes = term_hashes(pa.array([row["text"]], pa.string()))[0]
        if block and (len(block) >= most_queries or len(hashes) > room):
            yield block
            block, room = [], most_terms
        block.append((row, hashes))
        room -= len(hashes)
    if block:
        yield block


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 20,
    block_queries: int = BLOCK_QUERIES,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_col, rank, id_col, score) of the k best documents of every item, scores above 0 only.

    With N documents that have a term, L terms in all, n in a document and a
    term in df of the N, its weight is floor(1000 * ln((2N + 2) / (2df + 1))).
    An item's score of a document is the sum over its terms, with repeats, of
    weight * ((10**9 * tf) div (1000 * tf + 12 * m)), where
    m = 75 + ((25 * n * N) div L). Equal scores rank by ascending id.

    The driver holds one block of items at a time, bounded in items and terms;
    each block costs one pass over the documents. A task holds the accumulators
    of some documents and k rows an item. Terms are compared by 64-bit hashes.

    Defined cases: null, empty and term-free texts match nothing and don't
    count in N. Each row of ``items`` is ranked by itself, also where ids
    repeat or are null; so is each row of ``docs``, null ids last among equal
    scores. Other columns are not read. An empty table on either side gives no
    rows.
    """
    spark = docs.sparkSession
    out_schema = f"`{item_col}` long, rank int, `{id_col}` long, score long"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    queries = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], out_schema)
    with Scratch(spark) as tmp:
        for block in _blocks(queries, block_queries, block_terms):
            known = np.unique(np.concatenate([hashes for _, hashes in block]))
            if not len(known):
                continue
            table = source.mapInArrow(_frequencies(known), "id long, n long, terms array<int>, tfs array<long>")
            table = tmp.write(table, "term-frequencies")
            n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(known), np.int64)
            for term, count in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                df[term] = count
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
            plan = share([np.searchsorted(known, hashes).tolist() for _, hashes in block])
            scorer = _Scorer(plan, weights, n_docs, n_terms)
            best = table.mapInArrow(_best_of_task(scorer, k), "query long, doc_id long, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(q, row["id"]) for q, (row, _) in enumerate(block)], "query long, item long")
            ranked = ranked.join(names, "query").select(
                F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"
            )
            found = found.unionByName(tmp.write(ranked, "lexical-search", keep=True))
    return found
