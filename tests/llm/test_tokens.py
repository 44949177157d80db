"""Packing, byte-level BPE and token counts against the libraries."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty, frame, rows
from tokenizers import Tokenizer

from shelfcast.llm import byte_bpe, held, language_id, packing, paragraph_dedup, token_scan, tokens

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


TEXTS = st.text(st.sampled_from(list("abtheT' \n\t  é1,.!<|>ßñ\U0001f600́\x1c\x85")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_byte_bpe_matches_the_library(library, texts):
    ids, bounds = byte_bpe.model(RANKS, P.PATTERN).column(texts)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [byte_bpe.model(RANKS, P.PATTERN).decode(x) for x in got] == [t.encode() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_encoders_match_the_libraries(library, word_library, texts):
    for made, one in (
        (tokens.cached_encoder(tokens.RankEncoder, RANKS, P.PATTERN), library.encode_ordinary),
        (tokens.cached_encoder(tokens.WordEncoder, WORDS), lambda t: word_library.encode(t, add_special_tokens=False).ids),
    ):
        ids, bounds = made.column(pa.array([*texts, None], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [*map(one, texts), []]


def test_perfect_hash_is_minimal_and_perfect():
    keys = [f"key{i}".encode() for i in range(5000)]
    found = byte_bpe.PerfectHash(keys)
    assert sorted(found.slot_key.tolist()) == list(range(5000))
    assert found.candidates(keys).tolist() == list(range(5000))


def test_store_of_pre_tokens_starts_anew(library):
    small = byte_bpe.ByteBpe(RANKS, P.PATTERN, memo=3)
    for t in ("some words here that differ", "other words come now", "some words again"):
        assert small.column([t])[0].tolist() == library.encode_ordinary(t)


def test_encode_documents_cases(spark, library):
    got = byte_bpe.encode_documents(frame(spark), RANKS, P.PATTERN)
    both = byte_bpe.decode_documents(got, RANKS, P.PATTERN).collect()
    expected = sorted(((i, library.encode_ordinary(t or "")) for i, t, *_ in rows()), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in both), key=str) == expected
    assert all(bytes(r["decoded"]) == library.decode_bytes(r["ids"]) for r in both)
    assert byte_bpe.encode_documents(empty(spark), RANKS, P.PATTERN, decode=True).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_never_overfills(lengths, open_bins):
    packer, bins = packing.BestFit(20, open_bins), {}
    for n in lengths:
        number, offset = packer.place(n)
        assert offset == bins.get(number, 0)
        bins[number] = offset + n
        assert bins[number] <= 20 and packer.open <= open_bins
    assert len(bins) == packer.next_bin


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n)[0] for n in (6, 5, 4)] == [0, 1, 0]  # 4 fits 0 exactly, not 1
    assert [packer.place(n)[0] for n in (9, 8, 2)] == [2, 3, 3]  # bin 2, with 1 left, was closed


def test_pack_documents_cases(spark, word_library):
    got = packing.pack_documents(frame(spark), tokens.WordEncoder, WORDS, shard_docs=9).collect()
    expected = []
    for i, t, *_ in rows():
        ids = [*word_library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[at : at + 2048], "<u4")
            expected.append((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048
    assert packing.pack_documents(empty(spark), tokens.WordEncoder, WORDS).count() == 0


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts_of_documents(spark, library, block, tmp_path):
    files = token_scan.token_files(
        frame(spark), tokens.RankEncoder, RANKS, P.PATTERN, end_id=50_256, block=block
    )
    files.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    got = token_scan.token_counts(files, 50_256, run_blocks=4)
    assert got.where("not terminated").count() == 0
    found = sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=str)
    assert found == sorted(((i, len(library.encode_ordinary(t or ""))) for i, t, *_ in rows()), key=str)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7))
def test_scan_of_any_stream(spark, stream, block):
    """0 ends a document; blocks cut anywhere, runs of two blocks, an open tail."""
    cut = [stream[k : k + block] for k in range(0, len(stream), block)]
    data = [(5, k, bytearray(np.array(c, "<u2").tobytes()), None) for k, c in enumerate(cut)]
    frame_ = spark.createDataFrame(data, token_scan.FILE_SCHEMA)
    got = sorted(
        (r["ordinal"], r["start"], r["n_tokens"], r["terminated"])
        for r in token_scan.token_counts(frame_, 0, run_blocks=2).collect()
    )
    expected, start, ordinal = [], 0, 0
    for at, x in enumerate(stream):
        if x == 0:
            expected.append((ordinal, start, at - start, True))
            start, ordinal = at + 1, ordinal + 1
    if start < len(stream):
        expected.append((ordinal, start, len(stream) - start, False))
    assert got == expected


def test_a_worker_holds_the_last_model_and_none_beside_other_work(monkeypatch):
    made = []

    class Encoder:
        def __init__(self, path):
            made.append(path)

    held.release()
    first = tokens.cached_encoder(Encoder, "a")
    assert tokens.cached_encoder(Encoder, "a") is first and made == ["a"]
    parser = language_id._parser({"en": "the of and"})
    assert language_id._parser({"en": "the of and"}) is parser and list(held._held.values()) == [parser]
    assert tokens.cached_encoder(Encoder, "a") is not first and made == ["a", "a"]
    batch = pa.RecordBatch.from_pydict({"id": [1], "text": ["one two"]})
    list(paragraph_dedup._seeds(12, 14, 50)(iter([batch])))
    assert not held._held
