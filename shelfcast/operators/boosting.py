"""Gradient boosting of regression trees on histograms (M6), many ensembles in one pass.

Squared error with an L2 penalty on leaves: a split gains
``G_l^2 / (n_l + L2) + G_r^2 / (n_r + L2) - G^2 / (n + L2)`` and a leaf is
``-rate * G / (n + L2)``, with G the sum of gradients (prediction - label) of its
n rows.

The vectors are binned once and written: slots with one value besides zero
(one-hot, flags) as lists of the rows' ones, all others as one byte each, cut at
their distinct values or 256 quantiles. Blocks of rows carry the predictions so
far. A level of a tree is one pass: tasks add up their blocks' histograms of
(node, slot, bin), which are summed; of two siblings only the smaller is
counted, the other is its parent less that. All ensembles that are asked for
take each pass together, and one with fewer trees is a prefix of one with more.
Where all blocks are measured to be at most ``TASK_BYTES``, a pass needs no
exchange: each ensemble is then one task over its copy of the blocks, and, since
sums are exact, has the same trees. Such a task counts slots together: those that
no row has both of, and those that take few values together, as one column.

Gradients are summed as integers (multiples of 2**-22), so trees don't depend on
how rows are dealt. What reaches the driver is bounded by nodes x bins, not by
rows. Every ``REWRITE`` trees the blocks are written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

import base64
import time
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import drop_written, new_output_path

MAX_BINS = 256
L2 = 1.0
#: A split must gain more than this.
LEAST_GAIN = 1e-6
GRADIENT_STEP = 2.0**-22
BLOCK_ROWS = 8192
#: Bytes of a block partition, about: small inputs take few tasks a pass.
PARTITION_BYTES = 4 << 20
REWRITE = 25
#: Blocks of at most so many bytes are handed whole to one task an ensemble.
TASK_BYTES = 32 << 20
#: Values that slots counted as one column may take together.
COLUMN_VALUES = 512
#: Partial sums that the driver adds up by itself; more are first added up in tasks.
DRIVER_PARTS = 64
_ACCURACY = 100_000


class Ensemble(NamedTuple):
    depth: int
    rate: float
    trees: int


class Bins(NamedTuple):
    """How vector slots are cut: ``many`` with their cut points (a value lies in the bin of the first
    cut point that is not below it), ``single`` with the one value they take besides zero."""

    width: int
    many: list[int]
    cuts: list[list[float]]
    single: list[int]
    values: list[float]

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])]).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, value) of the values a task meets; a slot of more than MAX_BINS has one null."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        x = _matrix(batch.column(0))
        for slot in range(x.shape[1]):
            before = seen.get(slot, np.empty(0))
            if len(before) <= MAX_BINS:
                seen[slot] = np.union1d(before, x[:, slot])
    slots, values = [], []
    for slot, found in seen.items():
        found = found.tolist() if len(found) <= MAX_BINS else [None]
        slots += [slot] * len(found)
        values += found
    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(values, pa.float64())], names=["slot", "value"])


def find_bins(vectors: DataFrame) -> Bins:
    """Cut points of every slot of the column ``features``."""
    array = vectors.select(vector_to_array("features").alias("x"))
    found = array.mapInArrow(_distinct, "slot int, value double").groupBy("slot").agg(
        F.max(F.col("value").isNull()).alias("open"), F.array_sort(F.collect_set("value")).alias("values")
    )
    few = found.select("slot", (F.col("open") | (F.size("values") > MAX_BINS)).alias("open"), F.slice("values", 1, MAX_BINS).alias("values"))
    rows = sorted(few.collect())
    many, cuts, single, values = [], [], [], []
    for row in rows:
        nonzero = [v for v in row.values if v]
        if row.open:
            many.append(row.slot)
            cuts.append([])
        elif len(nonzero) == 1 and len(row.values) == 2:
            single.append(row.slot)
            values.append(nonzero[0])
        elif len(row.values) > 1:
            many.append(row.slot)
            cuts.append(list(row.values[:-1]))
    open_slots = [s for s, c in zip(many, cuts) if not c]
    if open_slots:
        at = [k / MAX_BINS for k in range(1, MAX_BINS)]
        near = array.agg(*[F.percentile_approx(F.col("x")[s], at, _ACCURACY).alias(f"s{s}") for s in open_slots]).first()
        top = array.agg(*[F.max(F.col("x")[s]).alias(f"s{s}") for s in open_slots]).first()
        for k, slot in enumerate(many):
            if slot in open_slots:
                cuts[k] = [c for c in sorted(set(near[f"s{slot}"])) if c < top[f"s{slot}"]]
    return Bins(len(rows), many, cuts, single, values)


class _Block(NamedTuple):
    """Some rows: ``codes`` (slot, row) of all slots in the order of bins, many first, then single."""

    codes: np.ndarray
    one_row: np.ndarray
    one_slot: np.ndarray
    label: np.ndarray
    #: (ensemble, row)
    margin: np.ndarray


#: ``ones``: how many single slots each row has; ``one_slot``: which, row by row.
_BLOCK_SCHEMA = "rows int, codes binary, ones binary, one_slot binary, label binary, margin binary"


def _one_type(bins: Bins) -> type:
    """Holds a single slot's number, and how many of them a row has."""
    return np.uint16 if len(bins.single) < 1 << 16 else np.int32


def _blocks(bins: Bins, base: float, ensembles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x, label = _matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                codes = [np.searchsorted(c, x[:, s]).astype(np.uint8) for s, c in zip(bins.many, bins.cuts)]
                codes = np.concatenate(codes) if codes else np.empty(0, np.uint8)
                ones = x[:, bins.single] > np.array(bins.values) / 2 if bins.single else np.zeros((len(x), 0), bool)
                slot, one = np.nonzero(ones)[1], _one_type(bins)
                margin = np.full(ensembles * len(x), base)
                parts = codes, ones.sum(axis=1).astype(one), slot.astype(one), label.astype(np.float64), margin
                columns = [pa.array([len(x)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["rows", "codes", "ones", "one_slot", "label", "margin"])

    return run


def _read(batch: pa.RecordBatch, k: int, bins: Bins, ensembles: int) -> _Block:
    n = batch.column("rows")[k].as_py()
    get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
    one = _one_type(bins)
    row, slot = np.repeat(np.arange(n), get("ones", one)), get("one_slot", one).astype(np.int64)
    codes = np.zeros((max(1, len(bins.many) + len(bins.single)), n), np.uint8)  # one at least, for leaves to point at
    codes[: len(bins.many)] = get("codes", np.uint8).reshape(len(bins.many), n)
    codes[len(bins.many) + slot, row] = 1
    return _Block(codes, row, slot, get("label", np.float64), get("margin", np.float64).reshape(ensembles, n))


class Tree:
    """A tree as arrays by heap number (root 1, children 2k and 2k + 1); slot -1 is a leaf."""

    def __init__(self, depth: int):
        size = 2 << depth
        self.slot = np.full(size, -1, np.int16)
        self.cut = np.zeros(size, np.int16)
        self.value = np.zeros(size)

    def step(self, codes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows at these nodes go next; at a leaf they stay."""
        slot = self.slot[node]
        right = codes[slot, np.arange(len(node))] > self.cut[node]
        return np.where(slot >= 0, 2 * node + right, node)

    def route(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row has come to after so many levels."""
        node = np.ones(codes.shape[1], np.int64)
        for _ in range(levels):
            node = self.step(codes, node)
        return node


class _Sums(NamedTuple):
    """Of some nodes: sums by (node, bin) of slots with many values, by (node, slot) of single ones, by node."""

    many: np.ndarray
    many_n: np.ndarray
    single: np.ndarray
    single_n: np.ndarray
    all: np.ndarray
    all_n: np.ndarray

    def __add__(self, other: _Sums) -> _Sums:
        return _Sums(*(a + b for a, b in zip(self, other)))

    def less(self, other: _Sums) -> _Sums:
        return _Sums(*(a - b for a, b in zip(self, other)))

    def of(self, nodes: Sequence[int]) -> _Sums:
        return _Sums(*(a[nodes] for a in self))


def _no_sums(nodes: int, bins: Bins) -> _Sums:
    many, single = int(bins.starts[-1]), len(bins.single)
    return _Sums(*(np.zeros(shape, np.int64) for shape in ((nodes, many), (nodes, many), (nodes, single), (nodes, single), (nodes,), (nodes,))))


def _count(block: _Block, gradient: np.ndarray, place: np.ndarray, nodes: int, bins: Bins) -> _Sums:
    """Sums of a block's rows; ``place`` is each row's node among those counted, or -1."""
    rows = np.flatnonzero(place >= 0)
    at, weight, size = place[rows], gradient[rows], int(bins.starts[-1])
    cell = (block.codes[: len(bins.many)][:, rows] + bins.starts[:-1, None] + at * size).ravel()
    weights = np.broadcast_to(weight, (len(bins.many), len(rows))).ravel()
    held = place[block.one_row] >= 0
    row, slot = block.one_row[held], block.one_slot[held]
    one = place[row] * len(bins.single) + slot

    def add(cells, count, weights=None):
        return np.bincount(cells, weights, count).astype(np.int64) if count else np.zeros(0, np.int64)

    many, single = nodes * size, nodes * len(bins.single)
    return _Sums(
        add(cell, many, weights).reshape(nodes, -1), add(cell, many).reshape(nodes, -1),
        add(one, single, gradient[row]).reshape(nodes, -1), add(one, single).reshape(nodes, -1),
        add(at, nodes, weight), add(at, nodes),
    )


def _gradient(block: _Block, ensemble: int) -> np.ndarray:
    return np.rint((block.margin[ensemble] - block.label) / GRADIENT_STEP)


def _place(node: np.ndarray, level: int, wanted: list[int]) -> np.ndarray:
    place = np.full(2 << level, -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    return place[node]


def _pack(sums: list[_Sums]) -> bytes:
    return b"".join(a.tobytes() for of_tree in sums for a in of_tree)


def _unpack(blob: bytes, nodes: list[int], bins: Bins) -> list[_Sums]:
    flat, at, out = np.frombuffer(blob, np.int64), 0, []
    for n in nodes:
        parts = []
        for like in _no_sums(n, bins):
            parts.append(flat[at : at + like.size].reshape(like.shape))
            at += like.size
        out.append(_Sums(*parts))
    return out


def _histograms(bins: Bins, ensembles: int, growing: list[tuple[int, Tree, int, list[int]]]):
    """One row a task: the sums of the wanted nodes of all growing trees (ensemble, tree, level, nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_no_sums(len(nodes), bins) for *_, nodes in growing]
        for batch in batches:
            for k in range(batch.num_rows):
                block = _read(batch, k, bins, ensembles)
                for i, (ensemble, tree, level, nodes) in enumerate(growing):
                    node = tree.route(block.codes, level)
                    sums[i] += _count(block, _gradient(block, ensemble), _place(node, level, nodes), len(nodes), bins)
        yield pa.RecordBatch.from_arrays([pa.array([_pack(sums)], pa.binary())], names=["sums"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("sums"):
            part = np.frombuffer(blob.as_buffer(), np.int64)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _summed(state: DataFrame, tasks: int, bins: Bins, ensembles: int, growing: list) -> list[_Sums]:
    parts = state.mapInArrow(_histograms(bins, ensembles, growing), "sums binary")
    while tasks > DRIVER_PARTS:
        tasks = max(DRIVER_PARTS, int(tasks**0.5))
        parts = parts.repartition(tasks).mapInArrow(_add_up, "sums binary")
    nodes = [len(n) for *_, n in growing]
    total = [_no_sums(n, bins) for n in nodes]
    for blob in parts.toArrow().column("sums"):
        total = [a + b for a, b in zip(total, _unpack(blob.as_buffer(), nodes, bins))]
    return total


def split_gains(sums: _Sums, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, gradient sum and rows of the right side) by (node, cut): a cut after each bin of the slots
    with many values, in order, then one for each single slot. A cut with an empty side gains -1."""
    starts = bins.starts
    ends = np.zeros(int(starts[-1]), bool)
    ends[starts[1:] - 1] = True

    def score(g, n):
        return (g * GRADIENT_STEP) ** 2 / (n + L2)

    def left_of(values):
        running = np.cumsum(values, axis=1)
        before = np.concatenate([np.zeros((len(values), 1), np.int64), running[:, starts[1:-1] - 1]], axis=1)
        return running - np.repeat(before, np.diff(starts), axis=1)

    whole, rows = sums.all[:, None], sums.all_n[:, None]
    right_g, right_n = sums.single, sums.single_n
    if len(starts) > 1:
        right_g = np.concatenate([whole - left_of(sums.many), right_g], axis=1)
        right_n = np.concatenate([rows - left_of(sums.many_n), right_n], axis=1)
    left_n = rows - right_n
    gain = score(whole - right_g, left_n) + score(right_g, right_n) - score(whole, rows)
    gain[(left_n < 1) | (right_n < 1)] = -1
    gain[:, : len(ends)][:, ends] = -1
    return gain, right_g, right_n


def best_splits(sums: _Sums, bins: Bins) -> list[tuple[float, int, int, int, int]]:
    """For each node (gain, slot in the order of bins, last bin of the left side, gradient sum and rows of the right side).

    Of equal gains the first slot and cut win, slots with many values before single ones.
    """
    gain, right_g, right_n = split_gains(sums, bins)
    if not gain.shape[1]:
        return [(-1.0, 0, 0, 0, 0)] * len(gain)
    starts, out = bins.starts, []
    for node, at in enumerate(np.argmax(gain, axis=1).tolist()):
        slot = int(np.searchsorted(starts, at, "right")) - 1 if at < starts[-1] else len(bins.many) + at - int(starts[-1])
        cut = at - int(starts[slot]) if at < starts[-1] else 0
        out.append((float(gain[node, at]), slot, cut, int(right_g[node, at]), int(right_n[node, at])))
    return out


class _Growth:
    """One tree of one ensemble, level by level."""

    def __init__(self, number: int, ensemble: Ensemble):
        self.number, self.ensemble, self.tree = number, ensemble, Tree(ensemble.depth)
        #: Nodes to be counted, and for each the sibling that is its parent less this one.
        self.wanted: list[tuple[int, int | None]] = [(1, None)]
        self.known: dict[int, _Sums] = {}

    def request(self, level: int):
        return self.number, self.tree, level, [node for node, _ in self.wanted]

    def advance(self, level: int, sums: _Sums, bins: Bins) -> None:
        nodes: dict[int, _Sums] = {}
        for k, (node, sibling) in enumerate(self.wanted):
            nodes[node] = sums.of([k])
            if sibling is not None:
                nodes[sibling] = self.known[node >> 1].less(nodes[node])
        self.known, self.wanted = nodes, []
        if not nodes:
            return
        order = sorted(nodes)
        stacked = _Sums(*(np.concatenate(parts) for parts in zip(*(nodes[n] for n in order))))
        for node, (gain, slot, cut, right_g, right_n) in zip(order, best_splits(stacked, bins)):
            g, n = int(nodes[node].all[0]), int(nodes[node].all_n[0])
            if gain <= LEAST_GAIN:
                self._leaf(node, g, n)
                continue
            self.tree.slot[node], self.tree.cut[node] = slot, cut
            left, right = 2 * node, 2 * node + 1
            if level + 1 == self.ensemble.depth:
                self._leaf(left, g - right_g, n - right_n)
                self._leaf(right, right_g, right_n)
            else:
                self.wanted.append((right, left) if right_n <= n - right_n else (left, right))

    def _leaf(self, node: int, g: int, n: int) -> None:
        self.tree.value[node] = -self.ensemble.rate * g * GRADIENT_STEP / (n + L2)


def _advanced(bins: Bins, ensembles: int, grown: list[tuple[int, Tree, int]]):
    """The blocks with the leaves of the new trees added to their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for k in range(batch.num_rows):
                block = _read(batch, k, bins, ensembles)
                margin = block.margin.copy()
                for ensemble, tree, depth in grown:
                    margin[ensemble] += tree.value[tree.route(block.codes, depth)]
                margins.append(margin.tobytes())
            columns = [batch.column(c) for c in batch.schema.names[:-1]] + [pa.array(margins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


class _Column(NamedTuple):
    """Slots counted together, in parts: one slot with many values, or single ones of which no row has two.
    ``targets``: for each part, where a code's sums belong among all bins: those of the slots with many
    values in order, then the single ones, then a place for none."""

    codes: np.ndarray
    size: int
    slots: list[list[int]]
    targets: list[np.ndarray]


def _apart(row: np.ndarray, slot: np.ndarray, slots: int) -> list[list[int]]:
    """The single slots in groups of which no row has two; ``slot`` row by row."""
    both, step = np.zeros((slots, slots), bool), 1
    while True:
        near = np.flatnonzero(row[step:] == row[:-step])
        if not len(near):
            break
        both[slot[near], slot[near + step]] = True
        step += 1
    both |= both.T
    groups: list[list[int]] = []
    taken: list[np.ndarray] = []
    for s in range(slots):
        k = next((k for k, t in enumerate(taken) if not t[s]), len(groups))
        if k == len(groups):
            groups.append([])
            taken.append(np.zeros(slots, bool))
        groups[k].append(s)
        taken[k] |= both[s]
    return groups


def _together(a: _Column, b: _Column) -> _Column | None:
    """Two columns as one, if they take few values together."""
    if a.size * b.size > 1 << 20:
        return None
    codes = a.codes.astype(np.int64) * b.size + b.codes
    held = np.flatnonzero(np.bincount(codes, minlength=a.size * b.size))
    if len(held) > max(COLUMN_VALUES, a.size, b.size):
        return None
    number = np.zeros(a.size * b.size, np.uint16 if len(held) <= 1 << 16 else np.int32)
    number[held] = np.arange(len(held))
    targets = [t[held // b.size] for t in a.targets] + [t[held % b.size] for t in b.targets]
    return _Column(number[codes], len(held), a.slots + b.slots, targets)


def _columns(table: pa.Table, bins: Bins) -> tuple[list[_Column], np.ndarray, np.ndarray]:
    """All rows' slots as few columns, their labels and margins."""
    batches = [(batch, k) for batch in table.to_batches() for k in range(batch.num_rows)]

    def get(name: str, kind: type) -> list[np.ndarray]:
        return [np.frombuffer(batch.column(name)[k].as_buffer(), kind) for batch, k in batches]

    label, margin, one = np.concatenate(get("label", np.float64)), np.concatenate(get("margin", np.float64)), _one_type(bins)
    row, slot = np.repeat(np.arange(len(label)), np.concatenate(get("ones", one))), np.concatenate(get("one_slot", one)).astype(np.int64)
    sizes = [batch.column("rows")[k].as_py() for batch, k in batches]
    codes = np.concatenate([c.reshape(len(bins.many), n) for c, n in zip(get("codes", np.uint8), sizes)], axis=1)
    starts, columns = bins.starts, []
    for k, own in enumerate(codes):
        columns.append(_Column(own, int(starts[k + 1] - starts[k]), [[k]], [np.arange(starts[k], starts[k + 1])]))
    for group in _apart(row, slot, len(bins.single)):
        number = np.zeros(len(bins.single), np.uint16 if len(group) < 1 << 16 else np.int32)
        number[group] = np.arange(1, len(group) + 1)
        own = np.zeros(len(label), number.dtype)
        mine = number[slot]
        own[row[mine > 0]] = mine[mine > 0]
        targets = np.append(starts[-1] + len(bins.single), starts[-1] + np.array(group))
        columns.append(_Column(own, len(group) + 1, [[len(bins.many) + s for s in group]], [targets]))
    found: list[_Column] = []
    for column in sorted(columns, key=lambda c: c.size):
        for k, other in enumerate(found):
            both = _together(other, column)
            if both is not None:
                found[k] = both
                break
        else:
            found.append(column)
    return found, label, margin.copy()


def _count_columns(columns: list[_Column], gradient: np.ndarray, rows: list[np.ndarray], bins: Bins) -> _Sums:
    """Sums of some nodes, of which the rows are given."""
    nodes, width = len(rows), int(bins.starts[-1]) + len(bins.single) + 1
    sizes = np.array([len(r) for r in rows])
    every = np.concatenate(rows) if rows else np.empty(0, np.int64)
    weight, node = gradient[every], np.repeat(np.arange(nodes), sizes)
    g, n = np.zeros((nodes, width)), np.zeros((nodes, width))
    for column in columns:
        cell = node * column.size
        cell += column.codes[every]
        cells = nodes * column.size
        own_g, own_n = (np.bincount(cell, w, cells).reshape(nodes, -1) for w in (weight, None))
        for target in column.targets:
            if len(column.targets) == 1:
                g[:, target], n[:, target] = own_g, own_n
                continue
            low = int(target.min())
            span = int(target.max()) + 1 - low
            at = (np.arange(nodes)[:, None] * span + (target - low)).ravel()
            g[:, low : low + span] += np.bincount(at, own_g.ravel(), nodes * span).reshape(nodes, -1)
            n[:, low : low + span] += np.bincount(at, own_n.ravel(), nodes * span).reshape(nodes, -1)
    many = int(bins.starts[-1])
    g, n = g.astype(np.int64), n.astype(np.int64)
    whole = np.bincount(node, weight, nodes).astype(np.int64)
    return _Sums(g[:, :many], n[:, :many], g[:, many:-1], n[:, many:-1], whole, sizes.astype(np.int64))


def _in_one_task(bins: Bins, ensembles: Sequence[Ensemble]):
    """Grows a whole ensemble over its copy of all blocks; one row, the trees' arrays."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        number, began = key[0].as_py(), time.time()
        ensemble = ensembles[number]
        columns, label, margin = _columns(table, bins)
        of_slot = {s: (c.codes, t) for c in columns for own, t in zip(c.slots, c.targets) for s in own}
        starts, many = bins.starts, len(bins.many)
        forest, seconds = [], []
        for _ in range(ensemble.trees):
            growth = _Growth(0, ensemble)
            tree, gradient = growth.tree, np.rint((margin - label) / GRADIENT_STEP)
            rows = {1: np.arange(len(label))}
            for level in range(ensemble.depth):
                *_, wanted = growth.request(level)
                growth.advance(level, _count_columns(columns, gradient, [rows[w] for w in wanted], bins), bins)
                below = {}
                for node, own in rows.items():
                    slot = tree.slot[node]
                    if slot < 0:
                        margin[own] += tree.value[node]
                        continue
                    codes, target = of_slot[int(slot)]
                    right = target > starts[slot] + tree.cut[node] if slot < many else target == starts[-1] + slot - many
                    goes = right[codes[own]]
                    below[2 * node], below[2 * node + 1] = own[~goes], own[goes]
                rows = below
                if not growth.wanted:
                    break
            for node, own in rows.items():
                margin[own] += tree.value[node]
            forest.append(tree)
            seconds.append(time.time() - began)
        parts = [b"".join(getattr(t, name).tobytes() for t in forest) for name in ("slot", "cut", "value")]
        columns = [pa.array([number], pa.int32()), *(pa.array([p], pa.binary()) for p in parts), pa.array([seconds], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(columns, names=["ensemble", "slot", "cut", "value", "seconds"])

    return run


def _forest(row, ensemble: Ensemble) -> list[Tree]:
    forest = [Tree(ensemble.depth) for _ in range(ensemble.trees)]
    for name in ("slot", "cut", "value"):
        flat = np.frombuffer(row[name], getattr(forest[0], name).dtype).reshape(len(forest), -1)
        for tree, values in zip(forest, flat):
            setattr(tree, name, values)
    return forest


def _task_by_ensemble(stored: DataFrame, bins: Bins, ensembles: Sequence[Ensemble]):
    """(trees, seconds) of each ensemble, grown side by side."""
    # A block's margins are equal before the first tree, so those of the first ensemble serve for any.
    first = F.expr(f"substring(margin, 1, length(margin) div {len(ensembles)})")
    copies = stored.withColumn("margin", first).withColumn("ensemble", F.explode(F.array(*map(F.lit, range(len(ensembles))))))
    schema = "ensemble int, slot binary, cut binary, value binary, seconds array<double>"
    dealt = copies.repartitionByRange(len(ensembles), "ensemble").groupBy("ensemble")
    # Tasks start in the order of their numbers: the longest first.
    order = sorted(range(len(ensembles)), key=lambda k: -ensembles[k].depth * ensembles[k].trees)
    rows = {order[r.ensemble]: r for r in dealt.applyInArrow(_in_one_task(bins, [ensembles[k] for k in order]), schema).collect()}
    return [(_forest(rows[k], e), list(rows[k].seconds)) for k, e in enumerate(ensembles)]


def _pass_by_pass(stored: DataFrame, path: str, size: int, bins: Bins, ensembles: Sequence[Ensemble]):
    """(trees, seconds) of each ensemble, all of them grown by the same passes over the blocks."""
    spark, began, count = stored.sparkSession, time.time(), len(ensembles)
    tasks = max(1, min(size // PARTITION_BYTES + 1, stored.count()))
    state, before = stored.repartition(tasks).persist(), None
    forests: list[list[Tree]] = [[] for _ in ensembles]
    seconds: list[list[float]] = [[] for _ in ensembles]
    for t in range(max(e.trees for e in ensembles)):
        growths = [_Growth(k, e) for k, e in enumerate(ensembles) if e.trees > t]
        for level in range(max(g.ensemble.depth for g in growths)):
            open_growths = [g for g in growths if g.wanted]
            if not open_growths:
                break
            sums = _summed(state, tasks, bins, count, [g.request(level) for g in open_growths])
            if before is not None:  # the pass has stored the blocks of this tree
                before.unpersist()
                before = None
            for growth, found in zip(open_growths, sums):
                growth.advance(level, found, bins)
        for g in growths:
            forests[g.number].append(g.tree)
            seconds[g.number].append(time.time() - began)
        before = state
        grown = [(g.number, g.tree, g.ensemble.depth) for g in growths]
        state = state.mapInArrow(_advanced(bins, count, grown), _BLOCK_SCHEMA)
        if (t + 1) % REWRITE == 0:
            written = new_output_path(spark, "boosting")
            state.write.parquet(written)
            before.unpersist()
            drop_written(spark, path)
            state, before, path = spark.read.parquet(written).repartition(tasks), None, written
        state = state.persist()
    if before is not None:
        before.unpersist()
    state.unpersist()
    drop_written(spark, path)
    return list(zip(forests, seconds))


def fit_ensembles(vectors: DataFrame, ensembles: Sequence[Ensemble]) -> list[tuple[BoostedTreesModel, list[float]]]:
    """For each ensemble its model and, tree by tree, the seconds until that tree stood.

    ``vectors`` has ``features`` (vectors without nulls or NaN) and ``label``; without rows it is refused.
    A slot of one value only is never split on. Equal input gives equal trees, however it is partitioned, as long as the bins are exact (up to 100,000 rows they always are;
    beyond, the quantiles of slots with more than 256 values are approximate).
    """
    # Passes are short and many: adaptive planning would only add to each. A session of its own keeps the caller's settings.
    spark = vectors.sparkSession.newSession()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    bins = find_bins(vectors)
    if not bins.width:
        raise ValueError("there are no training rows")
    base = round(float(vectors.agg(F.avg("label")).first()[0]), 6)
    rows = vectors.select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    path = new_output_path(spark, "boosting")
    rows.mapInArrow(_blocks(bins, base, len(ensembles)), _BLOCK_SCHEMA).write.parquet(path)
    stored = spark.read.parquet(path)
    held = F.length("codes") + F.length("ones") + F.length("one_slot") + 2 * F.length("label")
    size = stored.agg(F.sum(held)).first()[0] or 0
    if size <= TASK_BYTES:
        found = _task_by_ensemble(stored, bins, ensembles)
        drop_written(spark, path)
    else:
        found = _pass_by_pass(stored, path, size, bins, ensembles)
    return [(_model(bins, base, e, forest), seconds) for e, (forest, seconds) in zip(ensembles, found)]


def root_histogram(vectors: DataFrame) -> DataFrame:
    """(slot, bin, rows, gradient, gain) of the root of the first tree: the sum of gradients as a number of
    GRADIENT_STEPs, and what a cut after this bin gains (null after the last)."""
    spark = vectors.sparkSession
    bins = find_bins(vectors)
    base = round(float(vectors.agg(F.avg("label")).first()[0] or 0.0), 6)
    blocks = vectors.select(vector_to_array("features").alias("x"), F.col("label").cast("double"))
    blocks = blocks.mapInArrow(_blocks(bins, base, 1), _BLOCK_SCHEMA)
    sums = _summed(blocks, DRIVER_PARTS + 1, bins, 1, [(0, Tree(1), 0, [1])])[0]
    gain = split_gains(sums, bins)[0][0]
    rows = []
    for slot, start, cuts in zip(bins.many, bins.starts.tolist(), bins.cuts):
        for k in range(len(cuts) + 1):
            at = start + k
            rows.append((slot, k, int(sums.many_n[0, at]), int(sums.many[0, at]), float(gain[at]) if k < len(cuts) else None))
    g, n = int(sums.all[0]), int(sums.all_n[0])
    for k, slot in enumerate(bins.single):
        one_g, one_n = int(sums.single[0, k]), int(sums.single_n[0, k])
        rows.append((slot, 0, n - one_n, g - one_g, float(gain[int(bins.starts[-1]) + k])))
        rows.append((slot, 1, one_n, one_g, None))
    return spark.createDataFrame(rows, "slot int, bin int, rows long, gradient long, gain double")


def _model(bins: Bins, base: float, ensemble: Ensemble, forest: list[Tree]) -> BoostedTreesModel:
    """The trees over vectors: slots and thresholds in place of bins."""
    slots = np.array([*bins.many, *bins.single, 0], np.int64)
    middles = np.array(bins.values) / 2
    slot = np.array([t.slot for t in forest], np.int64).reshape(len(forest), -1)
    cut = np.array([t.cut for t in forest], np.int64).reshape(len(forest), -1)
    threshold = np.zeros(slot.shape)
    for k, cuts in enumerate(bins.cuts):
        threshold[slot == k] = np.array(cuts)[cut[slot == k]]
    for k, middle in enumerate(middles.tolist(), len(bins.many)):
        threshold[slot == k] = middle
    value = np.array([t.value for t in forest]).reshape(len(forest), -1)
    return BoostedTreesModel._of(base, bins.width, ensemble.depth, np.where(slot >= 0, slots[slot], -1), threshold, value)


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``prediction`` from ``features``; the trees are a parameter, so a pipeline saves and loads them."""

    forest = Param(Params._dummy(), "forest", "slots, thresholds and leaves, compressed", TypeConverters.toString)
    shape = Param(Params._dummy(), "shape", "trees, nodes of a tree, depth, vector width", TypeConverters.toListInt)
    base = Param(Params._dummy(), "base", "prediction before the first tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, forest=None, shape=None, base=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def _of(cls, base, width, depth, slot, threshold, value) -> BoostedTreesModel:
        raw = slot.astype("<i4").tobytes() + threshold.astype("<f8").tobytes() + value.astype("<f8").tobytes()
        packed = base64.b64encode(zlib.compress(raw, 1)).decode()
        return cls(forest=packed, shape=[*slot.shape, depth, width], base=float(base))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, threshold, value) by tree and heap number."""
        trees, nodes, *_ = self.getOrDefault(self.shape)
        raw, n = zlib.decompress(base64.b64decode(self.getOrDefault(self.forest))), trees * nodes
        parts = np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<f8", n, 4 * n), np.frombuffer(raw, "<f8", n, 12 * n)
        return tuple(p.reshape(trees, nodes) for p in parts)

    @property
    def numFeatures(self) -> int:
        return self.getOrDefault(self.shape)[3]

    @property
    def trees(self) -> int:
        return self.getOrDefault(self.shape)[0]

    def prefix(self, trees: int) -> BoostedTreesModel:
        """The ensemble of the first so many trees."""
        _, _, depth, width = self.getOrDefault(self.shape)
        return BoostedTreesModel._of(self.getOrDefault(self.base), width, depth, *(a[:trees] for a in self.arrays()))

    def staged(self, stages: Sequence[int]):
        """A function of a (row, slot) matrix: the predictions after each of these numbers of trees."""
        base, depth, arrays = self.getOrDefault(self.base), self.getOrDefault(self.shape)[2], self.arrays()

        def predict(x: np.ndarray) -> np.ndarray:
            slots, thresholds, values = arrays
            out, margin, rows = np.empty((len(stages), len(x))), np.full(len(x), base), np.arange(len(x))
            for t in range(max(stages, default=0) + 1):
                for k, stage in enumerate(stages):
                    if stage == t:
                        out[k] = margin
                if t == max(stages, default=0):
                    break
                node = np.ones(len(x), np.int64)
                for _ in range(depth):
                    slot = slots[t][node]
                    right = x[rows, slot] > thresholds[t][node]
                    node = np.where(slot >= 0, 2 * node + right, node)
                margin = margin + values[t][node]
            return out

        return predict

    def _transform(self, df: DataFrame) -> DataFrame:
        predict = self.staged([self.trees])

        @F.pandas_udf("double")
        def score(x):
            import pandas as pd

            return pd.Series(predict(np.stack(x.to_numpy()))[0] if len(x) else [], dtype="float64")

        return df.withColumn("prediction", score(vector_to_array("features")))


class BoostedTrees(Estimator):
    """One ensemble as a pipeline stage."""

    def __init__(self, trees: int, depth: int, rate: float):
        super().__init__()
        self.ensemble = Ensemble(depth, rate, trees)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        return fit_ensembles(df, [self.ensemble])[0][0]
