"""Exact, MinHash and paragraph deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty, frame, rows, words

from shelfcast.llm import bbit_minhash, exact_dedup, golomb, hashing, minhash_dedup, paragraph_dedup, passage_match
from shelfcast.llm.components import connected_components


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), max_size=200))
def test_golomb_round_trip(values):
    data = np.sort(np.array(values, np.uint64))
    assert golomb.decode(golomb.encode(data, 1 << 40)).tolist() == data.tolist()


def test_golomb_is_compact():
    data = np.sort(np.random.default_rng(1).integers(0, 1 << 29, 1 << 17, dtype=np.uint64))
    assert len(golomb.encode(data, 1 << 29)) * 8 < 14.2 * len(data)  # 12 bits between, and about 2


def test_word_hashes_follow_words_and_blocks(monkeypatch):
    texts = ["The cat\tsat", "", "the CAT sat on " + "z" * 3000, "é cat"]
    expected = [hashing.word_hashes(*_flat([w]))[0][0] for t in texts for w in t.encode().lower().split()]
    for block in (1 << 20, 8):
        monkeypatch.setattr(hashing, "_BLOCK", block)
        got, first = hashing.word_hashes(*_flat([t.encode() for t in texts]))
        assert got.tolist() == expected
        assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts]


def _flat(parts):
    ends = np.cumsum([0, *map(len, parts)])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def test_messages_hold_as_much_at_any_size():
    for n in (1 << 24, 1 << 28, 10**9, 10**12):
        blocks, owners = exact_dedup.shares(n)
        assert 25 < n / (blocks * owners) < 2 * exact_dedup.MESSAGE_ROWS
        # Neither a block nor an owner has more than some times the root of all.
        assert max(n / blocks, n / owners) < 32 * n**0.5


def test_copies_reach_an_owner_once_a_block():
    rng = np.random.default_rng(1)
    shas = [b"c" * 32] * 5000 + [rng.bytes(32) for _ in range(5000)] + [b"d" * 32]
    span, owners = 1 << 26, 8
    sent = pd.concat([
        exact_dedup._send(span, owners)(pd.DataFrame({"id": range(len(part)), "sha": part, "block": k}))
        for k, part in enumerate((shas[:6000], shas[6000:] + [b"d" * 32, b"e" * 32]))
    ])
    # 5,001 of the first block's 6,000 rows are copies of one text: one fingerprint.
    assert sum(len(golomb.decode(x)) for x in sent["prints"]) < 5000 + 10
    replies = pd.concat([exact_dedup._answer(own) for _, own in sent.groupby("owner")])
    found = []
    for k, part in enumerate((shas[:6000], shas[6000:] + [b"d" * 32, b"e" * 32])):
        rows = pd.DataFrame({"id": range(len(part)), "sha": part, "block": k})
        found += exact_dedup._suspects(span, owners)(rows, replies[replies["block"] == k])["sha"].tolist()
    assert found.count(b"c" * 32) == 5000 and found.count(b"d" * 32) == 2 and found.count(b"e" * 32) == 0
    assert len(found) < 5002 + 20  # and what shares a fingerprint by chance


def test_exact_dedup_cases(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark)).collect()), key=str)
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[(t or "").encode().lower()].append(i)
    expected = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            stays = i == keep and left > 0
            left -= stays
            expected.append((i, keep, len(ids), stays, hashlib.sha256(text).hexdigest()))
    expected = [(i, k, n, s, h) for i, k, n, s, h in expected]
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    cols = exact_dedup.exact_dedup(frame(spark)).columns
    order = [cols.index(n) for n in names]
    assert sorted([tuple(r[o] for o in order) for r in got], key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.without_copies(frame(spark), exact_dedup.exact_dedup(frame(spark)))
    assert kept.columns == frame(spark).columns
    assert Counter((r["text"] or "").encode().lower() for r in kept.collect()) == Counter(list(groups))


def brute(docs, width, least):
    """Smallest id reachable, by all pairs; ``docs`` is a list of (id, text)."""
    sets = defaultdict(list)
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= least * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize(("width", "least"), [(3, 85), (5, 80)])
def test_minhash_dedup_cases(spark, width, least):
    got = minhash_dedup.minhash_dedup(frame(spark), width=width, least=least).collect()
    component, sets = brute([(i, t) for i, t, *_ in rows() if i is not None], width, least)
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == component[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert minhash_dedup.minhash_dedup(empty(spark)).count() == 0


def test_minhash_dedup_large_group_of_near_copies(spark):
    """Chains of edits: many members share buckets but not all are linked, and cells are small."""
    rng = np.random.default_rng(4)
    base = words(50, 60).split()
    docs = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 9)):
            w[k] = f"edit{i}x{k}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    component, _ = brute(docs, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.minhash_dedup(df, width=3, least=85).collect()}
    assert got == component
    assert len(set(component.values())) > 20  # many stay alone


def test_estimate_is_near_the_similarity(spark):
    from pyspark.sql import functions as F

    banding = minhash_dedup.BANDING
    docs = [(1, words(1, 400)), (2, words(1, 400).replace("alpha", "changed", 6)), (3, words(2, 400))]
    table = minhash_dedup.sketch_table(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 3, banding)
    x, y = table.alias("x"), table.alias("y")
    est = bbit_minhash.estimated_similarity(F.col("x.bits"), F.col("y.bits"), banding.k)
    for r in x.join(y, F.col("x.id") < F.col("y.id")).select("x.id", F.col("y.id").alias("other"), est.alias("e")).collect():
        a, b = (bbit_minhash.shingle_set(dict(docs)[k].encode(), 3) for k in (r["id"], r["other"]))
        both = len(np.intersect1d(a, b))
        assert abs(r["e"] - both / (len(a) + len(b) - both)) < 0.17
    assert banding.miss(0.85) < 1e-6


def test_connected_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(500, 560)] + [(7, 7), (None, 3), (9, 8), (8, 9)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    expected = {**{i: 100 for i in range(100, 161)}, 1: 1, **{k: 1 for k in range(500, 560)}, 8: 8, 9: 8}
    assert got == expected
    none = spark.createDataFrame([], "a long, b long")
    assert connected_components(none, "a", "b").count() == 0


def grams(text, n=50):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def unique_words(seed, n):
    return " ".join(f"u{seed}n{k}" for k in range(n))


def test_passage_dedup_cases(spark):
    passage = unique_words("p", 60)
    near = " ".join("edit" if k == 30 else w for k, w in enumerate(unique_words("q", 80).split()))
    boiler = unique_words("b", 30)
    texts = {
        1: unique_words(1, 70) + "\n" + passage, 2: unique_words(2, 30) + " " + passage.upper() + " " + unique_words(3, 90),
        3: unique_words(4, 40) + " " + passage + "\n" + unique_words(5, 5), 4: unique_words("q", 80), 5: "é ü " + near + " ende",
        6: unique_words(6, 49), 7: unique_words(6, 49), 8: unique_words(7, 50), 9: unique_words(7, 50),
        10: boiler + " " + unique_words(8, 60), 11: boiler + " " + unique_words(9, 60), 12: boiler + " " + unique_words(9, 60),
        13: unique_words(10, 55) + " x " + unique_words(10, 55), 14: "same " * 400, 15: None, 16: "", 17: unique_words(11, 30_000),
    }
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in texts.items()] + [(None, passage, 1, "k")], "doc_id long, text string, place int, key string")
    got = paragraph_dedup.repeated_passages(df).collect()
    cut = {r["doc_id"]: texts[r["doc_id"]][r["start"] : r["stop"]] for r in got}
    assert cut[2] == passage.upper() and cut[3] == passage and cut[5] == near
    assert cut[9] == unique_words(7, 50) and cut[12] == texts[11] and cut[13] == unique_words(10, 55)
    assert set(cut) - {14} == {2, 3, 5, 9, 12, 13}
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 14}
    assert by[2]["component_id"] == by[3]["component_id"] == 1 and by[9]["component_id"] == 8
    assert by[2]["from_id"] == 1 and by[5]["from_id"] == 4 and by[12]["from_id"] == 11
    left = paragraph_dedup.without_passages(df, paragraph_dedup.repeated_passages(df))
    assert left.columns == df.columns and left.count() == df.count()
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert all(kept[i] == texts[i] for i in texts if i not in cut)
    assert kept[2] == unique_words(2, 30) + " " + unique_words(3, 90) and kept[9] == ""
    assert paragraph_dedup.repeated_passages(empty(spark)).count() == 0
    assert paragraph_dedup.repeated_passages(frame(spark)).count() > 0


def test_no_run_of_words_is_left_twice(spark):
    """Random texts that share runs of a few sentences, also where many share a shorter one."""
    rng = np.random.default_rng(8)
    pool = [unique_words(f"s{k}", int(rng.integers(8, 45))) for k in range(40)]
    texts = {}
    for i in range(150):
        parts = []
        for _ in range(rng.integers(1, 7)):
            at = int(rng.integers(0, 37))
            parts += pool[at : at + int(rng.integers(1, 4))] if rng.random() < 0.6 else [unique_words(f"d{i}x{rng.integers(9**9)}", 20)]
        texts[i] = " ".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    removals = paragraph_dedup.repeated_passages(df)
    spans = defaultdict(list)
    for r in removals.collect():
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    met = set()
    for i, t in sorted(texts.items()):
        w, at = [], 0
        for word in t.split():
            begin = t.index(word, at)
            at = begin + len(word)
            w.append((word.lower(), any(a <= begin < b for a, b in spans[i])))
        for k in range(len(w) - 49):
            run = tuple(x for x, _ in w[k : k + 50])
            if run in met:  # words of an earlier document: every one of them is in a removal
                assert all(gone for _, gone in w[k : k + 50])
        own = grams(t)
        met |= {tuple(x.decode() for x in g) for g in own}
        # What is removed repeats: each of its words is in a run that an earlier text, or this one, has.
    assert spans


def edited(text, places):
    """Other words at these places, the same ones for the same text."""
    return " ".join(f"edit{k}of{w}" if k in places else w for k, w in enumerate(text.split()))


def jaccard(x, y, n=5):
    a, b = grams(x, n), grams(y, n)
    return len(a & b) / len(a | b)


def removed_share(spark, texts, ident, passage):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {}
    for r in paragraph_dedup.repeated_passages(df).collect():
        found.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start"] : r["stop"]])
    if ident is None:
        return found
    return sum(w in " ".join(found.get(ident, [])).split() for w in passage.split()) / len(passage.split())


def test_similar_passages_are_found_whatever_their_minima(spark):
    """Fuzzy brute force: each of 300 passages of 50 words is in a later document with one edit (similarity 0.8)."""
    rng = np.random.default_rng(21)
    texts, least = {}, 1.0
    for k in range(300):
        passage = unique_words(f"f{k}", 50)
        other = edited(passage, {int(rng.integers(1, 49))})
        least = min(least, jaccard(passage, other))
        texts[k] = unique_words(f"l{k}", 20) + " " + passage + " " + unique_words(f"r{k}", 20)
        texts[1000 + k] = unique_words(f"m{k}", 30) + " " + other + " " + unique_words(f"s{k}", 10)
    assert 0.8 < least < 0.81
    found = removed_share(spark, texts, None, None)
    assert sorted(found) == sorted(i for i in texts if i >= 1000)


def test_near_copy_of_a_later_member_is_found(spark):
    """Seven documents share a short sentence; the last is a near copy of the third, or of the one before it."""
    boiler = unique_words("boiler", 30)
    texts = {k: unique_words(f"x{k}", 40) + " " + boiler + " " + unique_words(f"y{k}", 40) for k in range(6)}
    texts[10] = unique_words("z", 30) + " " + edited(unique_words("x2", 40), {30}) + " " + boiler
    texts[11] = unique_words("zz", 30) + " " + boiler + " " + edited(unique_words("y5", 40), {12})
    found = removed_share(spark, texts, None, None)
    assert set(found) == {10, 11}
    assert jaccard(found[10][0], unique_words("x2", 40) + " " + boiler) >= 0.8


def test_places_left_meet_every_earlier_one(spark):
    """Documents share 38 words, most of a passage, which go on in words of their own; each has a near copy."""
    boiler, texts = unique_words("boiler", 38), {}
    for k in range(24):
        own = boiler + " " + unique_words(f"y{k}", 13)
        texts[k] = unique_words(f"x{k}", 20) + " " + own + " " + unique_words(f"v{k}", 20)
        texts[100 + k] = unique_words(f"z{k}", 20) + " " + edited(own, {38}) + " " + unique_words(f"t{k}", 20)
        assert jaccard(own, edited(own, {38})) >= 0.8
    found = removed_share(spark, texts, None, None)
    assert set(found) == set(range(100, 124))


def test_documents_with_a_common_run_that_is_no_repeat_do_not_all_meet(spark, monkeypatch):
    """Runs of one word and a passage of 30 words, each in 60 documents; some have near copies with the run inside."""
    boiler, texts = unique_words("common", 30), {}
    for k in range(60):
        texts[k] = unique_words(f"a{k}", 30) + " the" * (26 + k % 20) + " " + unique_words(f"b{k}", 30)
        texts[100 + k] = unique_words(f"c{k}", 30) + " " + boiler + " " + unique_words(f"d{k}", 30)
    copies = {200: (7, 20), 201: (41, 27), 202: (107, 20), 203: (155, 63), 204: (130, 20)}
    for k, (of, at) in copies.items():
        texts[k] = unique_words(f"e{k}", 5) + " " + edited(texts[of], {at}) + " " + unique_words(f"f{k}", 5)
    sizes, write = {}, paragraph_dedup.Scratch.write

    def counted(self, df, name, keep=False):
        out = write(self, df, name, keep)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(paragraph_dedup.Scratch, "write", counted)
    found = removed_share(spark, texts, None, None)
    assert set(found) == set(copies)
    for k, (of, _) in copies.items():
        assert sum(w in " ".join(found[k]).split() for w in texts[of].split()) >= len(texts[of].split()) - 1
    # Each has itself, and each copy those that it may repeat: all 7,000 pairs, of over a million places, have met before.
    assert sizes["pairs"] < 3 * len(texts)


def test_words_of_a_settled_document_are_found(spark):
    """B repeats A with an edit; C has B's words, two edits away from A."""
    a = unique_words("abc", 56)
    b = edited(a, {18})
    c = edited(b, {37})
    one = {1: a, 2: b + " " + unique_words("e", 9), 3: unique_words("g", 20) + " " + edited(b, {37}) + " " + unique_words("h", 9)}
    assert jaccard(a, b) >= 0.8 > jaccard(a, c)
    assert set(removed_share(spark, one, None, None)) == {2, 3}
    # Groups of edited copies: every run of 50 words that an earlier document has is removed.
    rng, texts = np.random.default_rng(5), {}
    for g in range(12):
        versions = [unique_words(f"v{g}", 58)]
        for k in range(9):
            own = versions[int(rng.integers(0, len(versions)))]
            if rng.random() < 0.6:
                own = " ".join(f"e{g}x{k}x{n}" if n in set(rng.integers(3, 55, 1).tolist()) else w for n, w in enumerate(own.split()))
            versions.append(own)
            texts[100 * g + k] = unique_words(f"p{g}x{k}", 15) + " " + own + " " + unique_words(f"q{g}x{k}", 15)
    found, met = removed_share(spark, texts, None, None), set()
    for i in sorted(texts):
        gone = set(" ".join(found.get(i, [])).split())
        for run in grams(texts[i]) & met:
            assert {w.decode() for w in run} <= gone
        met |= grams(texts[i])


def test_similar_part_of_a_longer_match_is_found(spark):
    """160 words with an edit every 45, then a stretch with an edit every eight words."""
    good, bad = unique_words("good", 160), unique_words("bad", 160)
    texts = {1: good + " " + bad, 2: unique_words("o", 12) + " " + edited(good, {40, 85, 130}) + " " + edited(bad, set(range(4, 160, 8)))}
    assert jaccard(good, edited(good, {40, 85, 130})) >= 0.8 > jaccard(texts[1], texts[2])
    kept = " ".join(w for k, w in enumerate(good.split()) if k not in (40, 85, 130))
    assert removed_share(spark, texts, 2, kept) == 1
    assert removed_share(spark, texts, 2, bad) < 0.2


def with_edit(rng, words, kind, k):
    """The words with k of them inserted, deleted or replaced at one place, or with their halves swapped."""
    at = rng.randrange(10, len(words) - 10 - k)
    new = [f"e{rng.randrange(10**6)}" for _ in range(k)]
    if kind == "insert":
        return words[:at] + new + words[at:]
    if kind == "delete":
        return words[:at] + words[at + k :]
    if kind == "replace":
        return words[:at] + new + words[at + k :]
    return words[len(words) // 2 :] + words[: len(words) // 2]


def similar_words(texts, window=50, shingle=5, least=80, lengths=(44, 50, 56)):
    """For each text, by brute force, the places of words in a window that repeats words of an earlier text, with
    whose words it begins and ends: all windows of both, of some lengths, by exact Jaccard similarity."""
    def grams(words):
        return frozenset(tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1))

    out, seen = [], []
    for words in texts:
        held = set()
        for a in range(len(words) - window + 1):
            own, ends = grams(words[a : a + window]), {tuple(words[a : a + shingle]), tuple(words[a + window - shingle : a + window])}
            if any(len(own & other) * 100 >= least * len(own | other) for other in seen if ends <= other):
                held.update(range(a, a + window))
        out.append(held)
        seen += [grams(words[a : a + n]) for n in lengths for a in range(len(words) - n + 1)]
    return out


def test_passages_with_edits_of_any_kind_are_found(spark):
    """Recall over brute force: groups of copies with edits of their own (1 to 12 words in or out, halves moved),
    a passage of 30 words that all documents share, and one that is common to half of them but too short."""
    rng = np.random.default_rng(5)
    pick = random.Random(5)

    def fresh(n):
        return [f"w{int(x)}" for x in rng.integers(0, 10**6, n)]

    hot, short, passages = fresh(30), fresh(24), [fresh(70), fresh(95), fresh(130)]
    texts = []
    for k in range(26):
        parts = [fresh(pick.randrange(5, 20)), hot]
        if k % 2:
            parts += [fresh(9), short]
        kind = pick.choice(["insert", "delete", "replace", "swap"])
        parts += [fresh(pick.randrange(5, 15)), with_edit(pick, passages[k % 3], kind, pick.randrange(1, 13)), fresh(pick.randrange(5, 20))]
        texts.append([w for part in parts for w in part])
    expected = similar_words(texts)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = [set() for _ in texts]
    for r in paragraph_dedup.repeated_passages(df).collect():
        before, own = len(" ".join(texts[r["doc_id"]])[: r["start"]].split()), texts[r["doc_id"]]
        run = range(before, before + r["n_words"])
        found[r["doc_id"]].update(run)
        earlier = {w for t in texts[: r["doc_id"]] for w in t}
        assert sum(own[i] not in earlier for i in run) <= 0.2 * len(run)
    whole = sum(map(len, expected))
    caught = sum(len(a & b) for a, b in zip(expected, found))
    assert whole > 1000 and caught >= 0.99 * whole


@pytest.mark.parametrize("kind, k", [("insert", 3), ("insert", 4), ("insert", 6), ("insert", 8), ("delete", 5), ("delete", 12), ("replace", 7)])
def test_one_long_edit_in_the_middle(kind, k):
    rng = random.Random(k)
    base = [f"p{i}" for i in range(110)]
    copy = with_edit(rng, base, kind, k)
    x, y = ["a"] * 20 + copy + ["b"] * 20, ["c"] * 30 + base + ["d"] * 9
    anchors = [(20, 30)]
    (run,) = passage_match.repeats(x, y, anchors, 50, 5, 80, False)
    assert run == (20, 20 + len(copy))


def test_shingles_and_seeds_of_many_texts_follow_their_words():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, (4, 1 << 40)[k % 2], n).astype(np.uint64) for k, n in enumerate((0, 24, 25, 26, 300, 49, 50, 51, 1, 120))]
    flat, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    for width in (1, 2, 5, 6, 12, 25, 39, 50):
        for text in texts:
            n = min(width, len(text))
            expected = []
            for at in range(len(text) - n + 1 if n else 0):
                key = n
                for w in text[at : at + n].tolist():
                    key = (key * 0xFF51AFD7ED558CCD + w) % (1 << 64)
                expected.append(key)
            assert hashing.shingle_hashes(text, width).tolist() == hashing.mix64(np.array(expected, np.uint64)).tolist()
    for window in (25, 50):
        got, own = passage_match.seed_tables(flat, bounds, 12, 14, window)
        for k, text in enumerate(texts):
            keys = hashing.shingle_hashes(text, 12)
            order = [(int(v >> np.uint64(24)), p) for p, v in enumerate(hashing.mix64(keys ^ passage_match._SALT))]
            least = [min(order[f : f + 14])[1] for f in range(len(text) - 24 if len(text) >= window else 0)]
            first = [f for f, p in enumerate(least) if not f or p != least[f - 1]]
            last = [*(f - 1 for f in first[1:]), len(least) - 1]
            expected = [[int(keys[least[f]].view(np.int64)), least[f], f, min(e, len(text) - window)] for f, e in zip(first, last)]
            assert got[own == k].tolist() == expected


def test_documents_meet_by_packed_keys(monkeypatch):
    """What a task has of a key and path is sent as one row; who meets is as by comparing all rows of a key."""
    rng = np.random.default_rng(4)
    rows = [
        (k, p, bool(o), i) for k, p, o, i in zip(rng.integers(0, 60, 900).tolist(), rng.integers(0, 3, 900).tolist(),
        rng.random(900) < 0.3, rng.integers(-40, 40, 900).tolist())
    ] + [(99, 2, True, i) for i in range(50)] + [(98, 0, False, 7), (97, 0, True, 2**62), (97, 5, False, -(2**62))]
    expected = {
        (x[3], y[3]) for x in rows for y in rows
        if x[0] == y[0] and x[2] and y[3] < x[3] and (x[1] != y[1] or x[1] == paragraph_dedup._ANY)
    }
    packed = defaultdict(list)
    for k, p, o, i in rows:
        packed[k, p, o].append(i)
    table = pa.table({
        "key": [k for k, _, _ in packed], "path": pa.array([p for _, p, _ in packed], pa.int32()), "open": [o for _, _, o in packed],
        "ids": [np.array(i, np.int64).tobytes() for i in packed.values()],
    })
    for anchors in (1 << 18, 5):
        monkeypatch.setattr(paragraph_dedup, "_ANCHORS", anchors)
        got = [r for b in paragraph_dedup._meet(iter(table.to_batches(max_chunksize=7))) for r in zip(*b.to_pydict().values())]
        assert set(got) == expected
    assert list(paragraph_dedup._meet(iter([]))) == []
    text = " ".join(f"w{k}" for k in range(200))
    places = passage_match.seed_rows(hashing.word_hashes(*_flat([text.encode()]))[0], 12, 14, 25)[:, 1].tolist()
    held = [[{"place": p, "open": True} for p in places]] * 8
    batch = pa.RecordBatch.from_pydict({"id": list(range(8)), "text": [text] * 8, "places": held})
    (sent,) = paragraph_dedup._meetings(12, 14, 5, 50, 80)(iter([batch]))
    assert all(np.frombuffer(x, np.int64).tolist() == list(range(8)) for x in sent.column("ids").to_pylist())
