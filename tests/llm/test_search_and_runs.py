"""Ranked search, repeated byte strings and periodic runs against brute force, odd cases included."""

import math
import random
import re
from collections import Counter

import pytest
from llm_cases import empty, frame, rows

from shelfcast.llm import lexical_search, suffix_dedup, word_runs
from shelfcast.llm.query_sharing import share
from shelfcast.llm.suffix_runs import Suffix, common_prefix, decode, encode, merge

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "alpha gamma of of the"), (2, "Alpha GAMMA of the délta"), (3, None), (4, ""), (5, "absent, quite"),
    (5, "the the the"), (None, "alpha gamma of of the"), (6, "w1 w2 w3 w4 alpha gamma"), (7, "é É 東京"), (8, "x" * 5000),
]


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_search(docs, items, k=20):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m, tfs, score = 75 + 25 * len(bag) * n_docs // max(1, n_terms), Counter(bag), 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * tfs[t] // (1000 * tfs[t] + 12 * m)) if tfs[t] else 0
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"k": 3, "block_queries": 2}, {"block_terms": 1}])
def test_search_equals_brute_force(spark, options):
    items = spark.createDataFrame([(i, t, "x", 3) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int")
    found = lexical_search.search(frame(spark), items, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute_search([r[:2] for r in rows()], ITEMS, options.get("k", 20))
    assert sorted(map(tuple, found.collect()), key=repr) == expected


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty(spark), items).collect() == []
    assert lexical_search.search(frame(spark), items.where("false")).collect() == []
    assert lexical_search.search(frame(spark), items.where("item_id in (3, 4)")).collect() == []


@pytest.mark.parametrize("most_pairs", [0, 40, 1_000_000])
def test_sharing_keeps_every_query_whole(most_pairs):
    rng = random.Random(7)
    for _ in range(60):
        queries = [[rng.randrange(rng.choice([5, 40])) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 20))]
        plan = share(queries, most_pairs)
        sums = [Counter() for _ in plan.leaves]
        for bag, literals in zip(sums, plan.leaves):
            for term, count in literals:
                bag[term] += count
        for a, b in plan.sums:
            sums.append(sums[a] + sums[b])
        for query, nodes in zip(queries, plan.queries):
            assert sum((sums[n] for n in nodes), Counter()) == Counter(query)


def test_shared_sums_are_computed_once():
    queries = [[*range(20), 100 + q] for q in range(30)]
    plan = share(queries)
    # Twenty shared terms are one leaf, what each query has alone another.
    assert len(plan.leaves) == 31 and not plan.sums and all(len(nodes) == 2 for nodes in plan.queries)
    plan = share([[1, 2, 9], [1, 2, 8], [1, 7], [2, 6]])
    assert len(plan.sums) == 1


def test_merge_knows_common_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        runs = []
        for _ in range(rng.randrange(0, 9)):
            found = [Suffix(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))), b"q" * rng.randrange(4), 1, rng.random() < 0.5, bytes(16)) for _ in range(rng.randrange(1, 20))]
            found.sort(key=lambda s: s.ahead)
            run = decode(encode(found))
            assert run[0] == found
            runs.append(run)
        out = list(merge(runs))
        assert [s.ahead for s, _ in out] == sorted(s.ahead for run, _ in runs for s in run)
        assert all(common_prefix(a.ahead, b.ahead) == n for (a, _), (b, n) in zip(out, out[1:]))


def brute_repeats(texts, width):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        edges = [0] * (len(r) + 1)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                edges[i] += 1
                edges[i + width] -= 1
        covered, spans, depth = [], [], 0
        for i, step in enumerate(edges[:-1]):
            depth += step
            covered.append(depth > 0)
            if depth > 0 and (i == 0 or not covered[i - 1]):
                spans.append([i, i])
            if depth > 0:
                spans[-1][1] = i + 1
        out.append((len(r), [tuple(s) for s in spans], bytes(b for b, gone in zip(r, covered) if not gone)))
    return out


def corpus(rng, n, letters, width):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6 * width))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            if rng.random() < 0.4:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randrange(2 * width))))
            else:
                source = rng.choice(base)
                at = rng.randrange(len(source) + 1)
                parts.append(source[at : at + rng.randrange(3 * width)])
        if rng.random() < 0.1:
            parts.append(rng.choice(letters) * rng.randrange(3 * width))
        texts.append("".join(parts))
    return texts + [None, "", texts[0]]


#: Whole clusters with one owner; many owners of short runs; clusters beyond the bound, counted by windows.
SIZES = [{}, {"run_suffixes": 50, "owner_suffixes": 30}, {"run_suffixes": 7, "owner_suffixes": 20, "hot": 6}]


def repeats(docs, **options):
    found = suffix_dedup.repeated_strings(docs, **options).collect()
    return sorted(((r[0], r[1], [tuple(s) for s in r[2]], bytes(r[3])) for r in found), key=repr)


@pytest.mark.parametrize("options", SIZES)
@pytest.mark.parametrize("width, letters", [(16, "abcdé"), (40, "abcdefgh "), (13, "abc"), (24, "ab")])
def test_repeats_equal_brute_force(spark, monkeypatch, options, width, letters):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    texts = corpus(random.Random(width), 40, letters, width)
    ids = [i if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    expected = sorted(((i, *b) for i, b in zip(ids, brute_repeats(texts, width))), key=repr)
    assert repeats(docs, width=width, **options) == expected


def test_repeats_of_odd_cases(spark):
    docs = [r[:2] for r in rows()]
    expected = sorted(((i, *b) for (i, _), b in zip(docs, brute_repeats([t for _, t in docs], 400))), key=repr)
    assert any(spans for _, _, spans, _ in expected)
    assert repeats(frame(spark)) == expected
    assert repeats(empty(spark)) == []


def test_a_cluster_beyond_pairwise_comparison():
    rng = random.Random(11)
    for _ in range(40):
        width, core = 40, "x" * 16
        texts = ["".join(rng.choice("ab") for _ in range(24)) + core + "".join(rng.choice("ab") for _ in range(24)) for _ in range(30)]
        cluster = sorted({Suffix(t[24:].encode(), t[:24][::-1].encode(), 0, False, str(i).encode()) for i, t in enumerate(texts)})
        shared = [0] + [common_prefix(a.ahead, b.ahead) for a, b in zip(cluster, cluster[1:])]
        got = {name: (near, far) for name, near, far in suffix_dedup.resolve(list(zip(cluster, shared)), width)}
        for i, t in enumerate(texts):
            windows = [d for d in range(25) if any(t[24 - d : 64 - d] == o[24 - d : 64 - d] for j, o in enumerate(texts) if j != i)]
            assert got.get(str(i).encode()) == ((windows[0], windows[-1]) if windows else None)


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((i, length, q) for (i, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def periodic_texts():
    rng = random.Random(1)
    for _ in range(400):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randrange(120))]
        if words and rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = 1 + (len(words) - a) // rng.randrange(3, 9)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rng.random() < 0.3:
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] * rng.randrange(3, 7) + words[: rng.randrange(5)]
        yield rng.choice([" ", "\n", " \t"]).join(words)


def test_runs_equal_brute_force(spark):
    texts = [*periodic_texts(), *(t for _, t, *_ in rows() if len(t or "") < 9000), "a " * 3000, ("a " * 8 + "b ") * 300, "A a A a A a", "a a a a a", "a a a a a a"]
    ids = [k if k % 5 else None for k in range(len(texts))]
    docs = spark.createDataFrame([(k, t, 1, "r") for k, t in zip(ids, texts)], "doc_id long, text string, n_words int, runs string")
    found = word_runs.find_runs(docs.repartition(3))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    expected = []
    for k, text in zip(ids, texts):
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        runs = brute_runs(words) if len(words) < 1000 else None
        if runs is None:
            runs = [(0, 3000, 1)] if len(set(words)) == 1 else [*((9 * i, 8, 1) for i in range(300)), (0, 2700, 9)]
            runs.sort(key=lambda r: (r[0], r[2]))
        expected.append((k, len(words), runs, brute_collapse(words, runs)))
    got = [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_runs_of_long_and_empty_input(spark):
    long = " ".join(f"w{i}" for i in range(60_000)) + " tick tock" * 40_000
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    row = word_runs.find_runs(docs).first()
    assert row["n_words"] == 140_000 and [tuple(r) for r in row["runs"]] == [(60_000, 80_000, 2)]
    assert len(row["collapsed"].split()) == 60_002
    assert word_runs.find_runs(empty(spark)).collect() == []
