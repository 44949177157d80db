"""Scores of documents under a hierarchical Pitman-Yor bigram model, and a unigram base.

The context of a word is the word before it (or the document's start); each has
a restaurant of its own, known by 64 bits. Documents are cut into events (word,
context, document), packed into one message for each block of documents and
owner of words. Owners hold all events of their words: twice the events go to
them, first to draw seatings and report what others need of them (per context
the customers and, per sample, the tables; totals), then, with the sums over all
owners of the contexts they have, to draw the same seatings again and score. The
scores of a block's documents, a few numbers for each owner, are summed at last.

What is reported of contexts goes, packed, to homes, which have equal ranges of the
contexts, and comes back as sums in the order of the owner's contexts.

A very frequent word has its events spread over all owners by context; what is
common to them is a short table. The driver holds, for each sample, two numbers
for each frequent word and two more: a bound that does not grow with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import hashing
from shelfcast.llm.pitman_yor import Prior, Restaurants, context_probability, draw_tables, log_stirling, parent_probability
from shelfcast.llm.scratch import Scratch

#: Text bytes in a block, and on average for each owner of words.
BLOCK_BYTES = 4 << 20
OWNER_BYTES = 12 << 20
LEAST_OWNERS = 8
#: Owners for each home of contexts.
HOME_OWNERS = 4
#: A word is frequent if it is at least this share of the events; so there are at most 1 / share of them.
FREQUENT = 1 / 500
BURN, SAMPLES = 2, 3
_END = np.uint64(0x9D39247E33776D41)
_START = np.uint64(0x2AF7398005AAA5C7)
_MESSAGE = "owner long, block string, ids array<long>, train array<boolean>, lengths array<int>, payload binary"


def _events(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, context and document of every event, and the number of events of each document."""
    data, bounds = hashing.text_bytes(piece.column("text"))
    words, first = hashing.word_hashes(data, bounds)
    counts = np.diff(first)
    own = np.insert(words, first[1:], _END)
    ends = np.cumsum(counts + 1)
    before = np.empty(len(own), np.uint64)
    before[1:] = own[:-1]
    before[ends - counts - 1] = _START
    return own, context_of(before), np.repeat(np.arange(len(counts)), counts + 1), counts + 1


def context_of(before: np.ndarray) -> np.ndarray:
    """A bijection of the hash of the word before: no two contexts are one."""
    return hashing.mix64(before ^ np.uint64(0x6C62272E07BB0142))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the words that are FREQUENT / 2 of it, and under word 0 all its events.

    What a block leaves out only changes where a word's events are counted, never a result's meaning.
    """
    for piece in hashing.slices(batches, "text", BLOCK_BYTES):
        words, _, _, _ = _events(piece)
        found, counts = np.unique(words, return_counts=True)
        many = counts >= len(words) * FREQUENT / 2
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(found[many], np.uint64(0)).view(np.int64)),
                pa.array(np.append(counts[many], len(words)).astype(np.int64)),
            ],
            names=["word", "n"],
        )


def _placed(words: np.ndarray, contexts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A hash in whose order owners stand: of the word, for frequent words of word and context."""
    spread = np.flatnonzero(np.isin(words, frequent))
    keyed = words ^ np.uint64(0x51ED270B9F1C2A11)
    keyed[spread] ^= hashing.mix64(contexts[spread] + np.uint64(1))
    return hashing.mix64(keyed)


def _owner_of(place: np.ndarray, owners: int) -> np.ndarray:
    """Owners have equal ranges of the hash."""
    return ((place >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _pack(words: np.ndarray, contexts: np.ndarray, docs: np.ndarray) -> bytes:
    """Events that are in order: the word of each run of equal ones, its length, the different contexts, and of each
    event the number of its context and the document."""
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    found, counts = words[first], np.diff(np.append(first, len(words)))
    kinds, at = np.unique(contexts, return_inverse=True)
    head = np.array([len(found), len(words), len(kinds), int(docs.max()) + 1], "<u8")
    body = (found, "<u8"), (kinds, "<u8"), (counts, "<u4"), (docs, _numbers(head[3])), (at, _numbers(len(kinds)))
    return b"".join([head.tobytes(), *(x.astype(kind).tobytes() for x, kind in body)])


def _numbers(n: int) -> np.dtype:
    """The type of numbers below ``n``."""
    return np.dtype("<u2" if n <= 1 << 16 else "<u4")


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their numbers of events, contexts, and of each event its document and the number of its context."""
    n, m, k, size = np.frombuffer(blob, "<u8", 4).tolist()
    at = 32
    found = np.frombuffer(blob, "<u8", n, at)
    kinds = np.frombuffer(blob, "<u8", k, at := at + 8 * n)
    counts = np.frombuffer(blob, "<u4", n, at := at + 8 * k)
    docs = np.frombuffer(blob, _numbers(size), m, at := at + 4 * n)
    return found, counts, kinds, docs, np.frombuffer(blob, _numbers(k), m, at + docs.nbytes)


def _messages(owners: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = pyspark.TaskContext.get()
        task, number = (context.partitionId() if context else 0), 0
        for piece in hashing.slices(batches, "text", BLOCK_BYTES):
            words, contexts, docs, lengths = _events(piece)
            place = _placed(words, contexts, frequent)
            order = np.argsort(place)
            words, contexts, docs = words[order], contexts[order], docs[order]
            cuts = np.searchsorted(_owner_of(place[order], owners), np.arange(owners + 1))
            train = piece.column("train").to_pylist()
            name, ids = f"{task}-{number}", piece.column("id").to_pylist()
            number += 1
            rows = []
            for k in range(owners):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    rows.append((k, name, None, train, None, _pack(words[a:b], contexts[a:b], docs[a:b])))
            # One more row carries the block's documents to where its scores are summed.
            carrier = -1 - zlib.crc32(name.encode()) % owners
            rows.append((carrier, name, ids, train, lengths.tolist(), None))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(c), kind)
                    for c, kind in zip(
                        zip(*rows),
                        [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()],
                    )
                ],
                names=["owner", "block", "ids", "train", "lengths", "payload"],
            )

    return run


class _Owner:
    """The events of one owner's words, with the counts of its training events."""

    def __init__(self, pdf: pd.DataFrame, prior: Prior, frequent: np.ndarray):
        pdf = pdf.sort_values("block", kind="stable")
        self.blocks = pdf["block"].tolist()
        self.sizes = [len(t) for t in pdf["train"]]
        parts = [_unpack(x) for x in pdf["payload"]]
        flags = [np.asarray(t, bool)[p[3]] for t, p in zip(pdf["train"], parts)]
        self.at = [p[3] for p in parts]
        self.words, run = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        self.contexts, kind = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        key = np.repeat(run.astype(np.int64) << 32, np.concatenate([p[1] for p in parts]))
        at = first = 0
        for _, _, kinds, _, number in parts:
            key[at : at + len(number)] |= kind[first : first + len(kinds)][number]
            at, first = at + len(number), first + len(kinds)
        train = np.concatenate(flags)
        del run, kind, parts, flags
        self.keys, entry, count = _counted(key, train)
        self.entry, self.count = entry, count
        self.word = self.keys >> 32
        self.context = self.keys & 0xFFFFFFFF
        self.word_count = np.bincount(self.word, count, len(self.words)).astype(np.int64)
        seen = np.flatnonzero(count)
        self.seen = seen
        self.spread = np.isin(self.words, frequent)
        self.model = Restaurants(
            self.word[seen], self.context[seen], count[seen], len(self.words), len(self.contexts), prior, self.spread
        )

    def samples(self, owner: int, owners: int, burn: int, keep: int):
        return self.model.sample(owner + 1, owners, burn, keep)


def _counted(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, entry = np.unique(key, return_inverse=True)
    return keys, entry.astype(np.int32), np.bincount(entry, train, len(keys)).astype(np.int64)


def _report_schema(keep: int) -> str:
    return "kind string, owner long, k long, " + ", ".join(f"{c} long" for c in _sums(keep)) + ", contexts binary, sums binary"


def _squeezed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, kind: str, shape: tuple[int, int]) -> np.ndarray:
    size = shape[0] * shape[1] * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), kind).reshape(shape)


def _sums(keep: int) -> list[str]:
    """The numbers of a report's row: n, and one for each sample."""
    return ["n", *(f"s{s}" for s in range(keep))]


def _report(owners: int, burn: int, keep: int, frequent: np.ndarray, prior: Prior):
    """What all owners need of this one, each a number and one for each sample. As rows to be summed: by frequent word its
    count and the parent's customers ('word'); and of the other words, together, the tokens and the parent's customers
    ('customers'), the types and the parent's tables ('tables'). And for each home, packed, the contexts with their customers
    and tables ('context'; also where these are 0, as words may be scored there)."""
    names = ["kind", "owner", "k", *_sums(keep)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["owner"].iloc[0])
        if number < 0:
            return pd.DataFrame({c: pd.Series(dtype="int64" if c in names[1:] else object) for c in [*names, "contexts", "sums"]})
        own = _Owner(pdf, prior, frequent)
        spread = own.spread
        slot = np.searchsorted(frequent, own.words[spread])
        rest = own.word_count[~spread]
        in_context = [np.bincount(own.context, own.count, len(own.contexts))]
        kinds = {
            "word": (slot, [own.word_count[spread]]), "customers": ([0], [[int(rest.sum())]]), "tables": ([0], [[int((rest > 0).sum())]]),
        }
        for tables, customers, root in own.samples(number, owners, burn, keep):
            in_context.append(np.bincount(own.context[own.seen], tables, len(own.contexts)))
            kinds["word"][1].append(customers[spread])
            kinds["customers"][1].append([int(customers[~spread].sum())])
            kinds["tables"][1].append([int(root[~spread].sum())])
        rows = [pd.DataFrame(dict(zip(names, [kind, number, k, *sums]))) for kind, (k, sums) in kinds.items()]
        sums, homes = np.stack(in_context).astype("<u4"), -(-owners // HOME_OWNERS)
        cuts = np.searchsorted(_owner_of(own.contexts, homes), np.arange(homes + 1))
        packed = [
            (h, own.contexts[a:b].astype("<u8").tobytes(), _squeezed(sums[:, a:b]))
            for h, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
        ]
        sent = pd.DataFrame(packed, columns=["k", "contexts", "sums"]).assign(kind="context", owner=number, **dict.fromkeys(_sums(keep), 0))
        return pd.concat([*rows, sent], ignore_index=True)[[*names, "contexts", "sums"]]

    return run


def _summed(keep: int):
    """For each owner the sums over all owners of its contexts in one home, in its order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        contexts = [np.frombuffer(x, "<u8") for x in pdf["contexts"]]
        kinds, at = np.unique(np.concatenate(contexts), return_inverse=True)
        total, bounds = np.zeros((keep + 1, len(kinds)), "<i8"), np.cumsum([0, *map(len, contexts)])
        for x, a, b in zip(pdf["sums"], bounds[:-1], bounds[1:]):
            # An owner has a context once.
            total[:, at[a:b]] += _unsqueezed(x, "<u4", (keep + 1, b - a))
        back = [_squeezed(total[:, at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
        return pd.DataFrame({"owner": pdf["owner"], "home": pdf["k"], "n": np.diff(bounds), "sums": back})

    return run


class Totals:
    """Sums over all owners, and the parent's tables of frequent words."""

    def __init__(self, rows: list, frequent: np.ndarray, keep: int, prior: Prior):
        n = len(frequent)
        self.frequent, self.keep, self.prior = frequent, keep, prior
        self.count, self.customers, self.tables = np.zeros(n, np.int64), np.zeros((keep, n), np.int64), np.zeros((keep, n), np.int64)
        rest = {kind: np.zeros(keep + 1, np.int64) for kind in ("customers", "tables")}
        for kind, k, *sums in rows:
            if kind == "word":
                self.count[k], self.customers[:, k] = sums[0], sums[1:]
            else:
                rest[kind] = np.array(sums)
        (tokens, *customers), (types, *tables) = rest["customers"], rest["tables"]
        self.tokens, self.types = int(tokens + self.count.sum()), int(types + (self.count > 0).sum())
        stirling, rng = log_stirling(prior.root_discount), np.random.default_rng(0)
        for s in range(keep):
            base = np.full(n, 1 / (self.types + 1))
            self.tables[s] = draw_tables(
                self.customers[s], np.full(n, tables[s]), base, prior.root_discount, prior.root_strength, rng, stirling
            )
        self.all_customers = np.array(customers) + self.customers.sum(axis=1)
        self.all_tables = np.array(tables) + self.tables.sum(axis=1)


_PARTIAL = "block string, ids array<long>, lengths array<int>, train array<boolean>, known array<int>, base array<double>, score array<float>"


def _score(owners: int, burn: int, keep: int, totals: Totals):
    """For each block of documents: of the owner's events those known, and the sums of log10(count + 1)
    and of the log10 of the predictive probability averaged over the samples. ``sums`` are those of the owner's contexts."""

    def run(pdf: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if pdf["owner"].iloc[0] < 0:
            out = pdf[["block", "ids", "lengths", "train"]].copy()
            out["known"] = out["base"] = out["score"] = None
            return out
        number = int(pdf["owner"].iloc[0])
        own = _Owner(pdf, totals.prior, totals.frequent)
        spread = own.spread
        slot = np.searchsorted(totals.frequent, own.words[spread])
        own.word_count[spread] = totals.count[slot]
        sums = sums.sort_values("home")
        sums = [_unsqueezed(x, "<i8", (keep + 1, n)) for x, n in zip(sums["sums"], sums["n"])]
        in_context, *context_tables = np.concatenate(sums, axis=1).astype(np.float64)
        chance = np.zeros(len(own.keys))
        for s, (tables, customers, root) in enumerate(own.samples(number, owners, burn, keep)):
            customers[spread], root[spread] = totals.customers[s, slot], totals.tables[s, slot]
            parent = parent_probability(
                customers, root, totals.all_customers[s], totals.all_tables[s], totals.types, totals.prior
            )
            placed = np.zeros(len(own.keys), np.int64)
            placed[own.seen] = tables
            chance += context_probability(
                own.count, placed, in_context[own.context], context_tables[s][own.context],
                parent[own.word], totals.prior,
            )
        score = np.log10(chance / keep)
        base = np.log10(own.word_count + 1.0)[own.word]
        known = (own.word_count > 0)[own.word]
        at, rows = 0, []
        for block, size, docs in zip(own.blocks, own.sizes, own.at):
            entry = own.entry[at : at + len(docs)]
            at += len(docs)
            rows.append(
                (block, np.bincount(docs, known[entry], size).astype(np.int32), np.bincount(docs, base[entry], size),
                 np.bincount(docs, score[entry], size).astype(np.float32))
            )
        out = pd.DataFrame(rows, columns=["block", "known", "base", "score"])
        out["ids"] = out["lengths"] = out["train"] = None
        return out[["block", "ids", "lengths", "train", "known", "base", "score"]]

    return run


_SCORED = "id long, train boolean, n_tokens long, n_known long, base double, score double"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scores of one block's documents, summed over the owners."""
    head = pdf[pdf["ids"].notna()].iloc[0]
    parts = pdf[pdf["base"].notna()].sort_values("order")
    total = {c: np.sum(parts[c].tolist(), axis=0, dtype=np.float64) for c in ("known", "base", "score")}
    return pd.DataFrame(
        {
            "id": pd.array(head["ids"], dtype="Int64"), "train": head["train"], "n_tokens": head["lengths"],
            "n_known": total["known"].astype(np.int64), "base": total["base"], "score": total["score"],
        }
    )


def score_documents(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    prior: Prior = Prior(),
    burn: int = BURN,
    keep: int = SAMPLES,
    owner_bytes: int = OWNER_BYTES,
) -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words of the text, lower-cased in A-Z, and one end. The
    model and the counts learn from the rows where ``train`` holds.
    base_score sums log10((c + 1) / (N + V + 1)) with the count c of each token
    in the N training tokens of V kinds, n_known counts tokens with c > 0.
    ``score`` is the log10 probability of the text under the model, of which
    each token's probability is averaged over ``keep`` samples of the seating;
    the perplexity is 10 ** (-score / n_tokens).

    Defined cases: a null or empty text is the end alone; where ``train`` is
    null a row is not learnt from; without training rows every token has
    probability 1. Rows that repeat an id, or have none, are scored each for itself.
    Other columns are not read but by ``train``. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(LEAST_OWNERS, -(-size // owner_bytes))
    common = source.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = common.where("word = 0").first()
    least = (top["n"] if top else 0) * FREQUENT
    # At most 1 / FREQUENT words, as their shares of the events add up to one at most.
    found = [r["word"] for r in common.where(F.col("word") != 0).where(F.col("n") >= least).select("word").collect()]
    frequent = np.sort(np.array(found, np.int64).view(np.uint64))

    messages = source.mapInArrow(_messages(owners, frequent), _MESSAGE)
    report = messages.groupBy("owner").applyInPandas(_report(owners, burn, keep, frequent, prior), _report_schema(keep))
    with Scratch(spark) as tmp:
        report = tmp.write(report, "lm-totals")
        others = report.where("kind != 'context'").groupBy("kind", "k").agg(*[F.sum(c).alias(c) for c in _sums(keep)])
        totals = Totals([tuple(r) for r in others.collect()], frequent, keep, prior)
        contexts = report.where("kind = 'context'").select("owner", "k", "contexts", "sums")
        contexts = contexts.groupBy("k").applyInPandas(_summed(keep), "owner long, home long, n int, sums binary")
        contexts = tmp.write(contexts, "lm-contexts", keep=True)
    partial = messages.groupBy("owner").cogroup(contexts.groupBy("owner")).applyInPandas(_score(owners, burn, keep, totals), _PARTIAL)
    partial = partial.withColumn("order", F.xxhash64("known", "base"))
    scored = partial.groupBy("block").applyInPandas(_gather, _SCORED)
    n, v = totals.tokens, totals.types
    return scored.select(
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
    )
