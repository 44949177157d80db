"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton is built over a bounded sample of its
labelled text. A document is parsed greedily into the longest phrases that
occur in that sample; phrases times log2 of the sample's length, per
character, estimates the cross entropy in bits. The language with the least wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfcast.llm import held
from shelfcast.llm.hashing import slices

#: Bounds of the sample of each language: rows, and characters over all of them.
SAMPLE_ROWS = 64
SAMPLE_CHARS = 49_152
#: Rows up to this length are taken first.
ROW_CHARS = 8_192
UNDETERMINED = "und"


def suffix_automaton(text: str) -> dict:
    """The start state of the automaton of all substrings of ``text``; a state maps a character to the next state."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        state = len(following)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    for state in following:
        for c, to in state.items():
            state[c] = following[to]
    return following[0]


def count_phrases(text: str, start: dict) -> int:
    """Number of phrases of the greedy parse; a character that never occurs is a phrase of its own."""
    phrases, state, nothing = 0, {}, {}
    for c in text:
        state = state.get(c)
        if state is None:
            phrases += 1
            state = start.get(c, nothing)
    return phrases


class CrossParser:
    """Predicts from ``samples``: language to labelled text."""

    def __init__(self, samples: dict[str, str]):
        self.models = [
            (lang, suffix_automaton(text), math.log2(len(text) + 2)) for lang, text in sorted(samples.items())
        ]

    def entropies(self, text: str) -> dict[str, float]:
        """Bits a character by language, of a text that is not empty."""
        text = normalised(text)
        return {lang: count_phrases(text, start) * bits / len(text) for lang, start, bits in self.models}

    def predict(self, text: str | None) -> tuple[str, float, float | None]:
        """Language, score from 0 to 1 (how far the second language is behind), bits a character."""
        if not text or not self.models or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, None
        ranked = sorted(self.entropies(text).items(), key=lambda x: (x[1], x[0]))
        second = ranked[1][1] if len(ranked) > 1 else math.inf
        return ranked[0][0], 1 - ranked[0][1] / second, ranked[0][1]


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower case, each run of anything but letters as one space."""
    return _NOT_LETTERS.sub(" ", text.lower())


def sample_texts(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    row_chars: int = ROW_CHARS,
) -> dict[str, str]:
    """For each language up to ``rows`` different texts, ``chars`` characters in all.

    Which rows: those of least text hash, rows of at most ``row_chars`` first.
    So copies count once and the choice depends on nothing but text and label.
    What reaches the driver is bounded by rows and chars for each language.
    """
    known = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where("lang is not null and length(text) > 0")
    keyed = known.select("lang", F.xxhash64("text").alias("h"), (F.length("text") > row_chars).alias("long"))
    keyed = keyed.groupBy("lang", "long", "h").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    chosen = keyed.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "h", "rank")
    # At most ``rows`` rows for each language.
    found = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"])
    found = found.groupBy("lang", "rank").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    samples: dict[str, str] = {}
    for row in sorted(found.collect(), key=lambda r: (r["lang"], r["rank"])):
        have = samples.get(row["lang"], "")
        samples[row["lang"]] = (have + ("\n" if have else "") + normalised(row["text"]))[:chars]
    return samples


def _parser(samples: dict[str, str]) -> CrossParser:
    """One set of automata in a Python worker."""
    return held.model(("parser", *sorted(samples.items())), lambda: CrossParser(samples))


def identify_language(
    docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(id_col, *keep, lang_pred, score, bits_per_char) of every row's whole text.

    Defined cases: a null text, or one without a letter, is ``und`` with score
    0 and null bits, as is every text if no language was learnt. Languages that
    tie rank by name. Rows that repeat an id, or have none, are predicted each
    for itself. Of other columns only those named in ``keep`` pass through.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for piece in slices(batches, text_col, 4 << 20):
            texts = piece.column(text_col).to_pylist()
            known = {t: parser.predict(t) for t in set(texts)}  # equal texts are parsed once
            found = [known[t] for t in texts]
            own = [piece.column(c) for c in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays(
                [
                    *own,
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                names=[id_col, *keep, "lang_pred", "score", "bits_per_char"],
            )

    own = list(dict.fromkeys([id_col, *keep, text_col]))
    schema = StructType([docs.schema[c] for c in (id_col, *keep)])
    schema = schema.add("lang_pred", "string").add("score", "double").add("bits_per_char", "double")
    return docs.select(*own).mapInArrow(run, schema)
