"""HTML extraction, fingerprints, language identification and language-model scores."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty, frame, rows, words
from pyspark.sql import functions as F

from shelfcast.llm import hashing, html_extract, language_id, lm_scoring, lz_fingerprint, pitman_yor
from shelfcast.llm.page_lines import CONTENT, DECLARED, OPEN, common_lines, page_lines


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=14), st.text("abcd", max_size=14), st.sampled_from([8, 1 << 20]))
def test_common_lines_is_a_longest_common_subsequence(a, b, most):
    kept = "".join(a[i] for i in sorted(common_lines(list(a), list(b), most)))
    rest = iter(b)
    assert all(c in rest for c in kept) and len(kept) == lcs(a, b)


def test_page_lines_kinds():
    page = """<!DOCTYPE html><title>t</title><script>var x="</p><p>no";</script><header>Site</header>
    <nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One<br>two&nbsp; three<p>A <b>b</b>old</p>
    <aside>Aside</aside><div id="comments"><p>Reader</p></div><form>Mail <input></form></article>
    <!-- c --><div class='AdBox'>Buy</div><footer>&copy; x"""
    assert page_lines(page) == [
        ("Site", DECLARED), ("Home", DECLARED), ("News", DECLARED), ("We use cookies", DECLARED), ("Head & line", CONTENT),
        ("One two three", CONTENT), ("A bold", CONTENT), ("Aside", DECLARED), ("Reader", DECLARED), ("Mail", DECLARED),
        ("Buy", DECLARED), ("© x", DECLARED),
    ]
    assert page_lines("<p>a<div>b</div>") == [("a", OPEN), ("b", OPEN)]
    assert page_lines("") == [] and page_lines("<a href='x") == [] and page_lines("1 < 2") == [("1 < 2", OPEN)]


def test_extract_pages_cases(spark):
    def plain(body):
        return f"<div>Shop of things</div><p>Top</p>{body}<p>All rights reserved</p>"

    data = [
        (1, "http://h.org/a/1", plain("<p>First</p>")), (2, "https://H.org/a/2?x=1", plain("<p>Second</p><p>More</p>")),
        (3, "http://h.org/b", plain("<p>Third</p>")), (4, "http://alone.org/", plain("<p>Single</p>")),
        (5, "http://copy.org/1", "<article><p>Same</p></article>"), (6, "http://copy.org/2", "<article><p>Same</p></article>"),
        (7, None, None), (8, "http://h.org/z", ""), (9, "not a url", "<p>x</p>"), (None, "http://q.org/1", "<p>u</p><p>v</p>"),
        (10, "http://rep.org/1", "<p>r</p><p>s</p>"), (10, "http://rep.org/1", "<p>r</p><p>s</p>"),
        (11, "http://long.org/1", "".join(f"<p>line {i}</p>" for i in range(3000))),
        (12, "http://long.org/2", "".join(f"<p>line {i}</p>" for i in range(0, 3000, 2)) + "<p>own</p>"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "page_id long, url string, html string, range long, host string")
    for least in (64, 3):
        html_extract.LEAST_RANGES = least
        got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
        text = {k: r["text"] for k, r in got.items()}
        assert [text[k] for k in (1, 2, 3)] == ["First", "Second\n\nMore", "Third"]
        assert text[4] == "Shop of things\n\nTop\n\nSingle\n\nAll rights reserved"
        assert text[5] == text[6] == "Same" and text[7] == text[8] == "" and text[9] == "x"
        assert text[None] == "u\n\nv" and text[10] == "r\n\ns"  # a copy is no template
        assert text[11].split("\n\n") == [f"line {i}" for i in range(1, 3000, 2)]
        # Its only neighbour has nearly all its lines: that may be a copy, so nothing goes.
        assert text[12].split("\n\n") == [*(f"line {i}" for i in range(0, 3000, 2)), "own"]
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    html_extract.LEAST_RANGES = 64
    assert html_extract.extract_pages(df).count() == len(data)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_articles_keep_what_only_a_part_of_a_name_declares():
    page = """<main><p class="market-share">Share</p><div id="search-results">Found</div><section class="related-work">Work</section>
    <p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><div class="ad big">Buy</div><div id="comments">Reader</div>
    <div role="search">Seek</div><aside>Beside</aside></main><div class="market-share">Out</div>"""
    assert page_lines(page) == [
        ("Share", CONTENT), ("Found", CONTENT), ("Work", CONTENT), ("Sum x+1", CONTENT), ("Buy", DECLARED), ("Reader", DECLARED),
        ("Seek", DECLARED), ("Beside", DECLARED), ("Out", DECLARED),
    ]


def test_copies_beside_a_page_are_no_template(spark, monkeypatch):
    """Print views, mirrors and repeated rows keep their article; the template goes where another page shows it;
    the same at any size of ranges, the first page included."""
    def page(body):
        return f"<div>Shop of things</div><p>Top</p>{body}<p>All rights reserved</p>"

    article = "".join(f"<p>Line {i} of the article</p>" for i in range(40))
    data = [(1, "http://two.org/a", page(article)), (2, "http://two.org/a?print=1", page(article))]
    data += [(10 + i, f"http://many.org/a?copy={i}", page(article)) for i in range(30)] + [(50, "http://many.org/b", page("<p>Own</p>"))]
    data += [(60 + i, f"http://some.org/a{i}", page(article.replace("Line 7", f"Line {i}"))) for i in range(4)]
    data += [(70, "http://some.org/b", page("<p>Own</p>")), (0, "http://a.org/1", page("<p>x</p>")), (80, "http://a.org/2", page("<p>y</p>"))]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    whole = "\n\n".join(f"Line {i} of the article" for i in range(40))
    for ranges in (1, 2, 64):
        monkeypatch.setattr(html_extract, "LEAST_RANGES", ranges)
        text = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
        assert len(text) == len(data) and text[0] == "x" and text[80] == "y"
        assert text[1] == text[2] == f"Shop of things\n\nTop\n\n{whole}\n\nAll rights reserved"
        # Near the end of the copies another page is in sight.
        assert all(whole in text[10 + i] for i in range(30)) and text[39] == whole and text[50] == "Own"
        assert [text[60 + i] for i in range(4)] == [whole.replace("Line 7", f"Line {i}") for i in range(4)]


def phrases(data: bytes) -> set:
    found, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in found:
            found.add(data[at:end])
            at = end
    return found


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 200))
def test_parse_gives_the_dictionary_and_can_be_continued(data, cut):
    parse = lz_fingerprint.Parse().feed(data[:cut])
    ends = parse.copy().feed(data[cut:]).ends
    assert ends == lz_fingerprint.Parse().feed(data).ends
    assert {data[a:b] for a, b in zip([0, *ends], ends)} == phrases(data)


def test_likeness_follows_the_phrase_sets():
    own = lz_fingerprint.Fingerprinter()
    a, b, c = words(1, 600), words(1, 600)[:2600] + words(2, 200), words(3, 600)
    for x, y in itertools.combinations((a, b, c), 2):
        p, q = phrases(x.encode()), phrases(y.encode())
        assert abs(lz_fingerprint.likeness(own.text(x), own.text(y)) - len(p & q) / len(p | q)) < 0.16
    assert lz_fingerprint.likeness(own.text(a), own.text(a)) == 1 and own.text("") == ""
    assert lz_fingerprint.likeness("", "") == 1 and lz_fingerprint.likeness("", own.text(a)) == 0


def test_dictionary_is_bounded():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    parse = lz_fingerprint.Parse(most=100).feed(data)
    assert len(parse.trie) < 100 and parse.ends[-1] <= 5000


def test_compare_neighbours_cases(spark):
    got = lz_fingerprint.compare_neighbours(frame(spark)).collect()
    key = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for t in {x[1] or "" for x in rows()}}
    order = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (x[0] is None, -(x[0] or 0), key[x[1]]))
    own, expected = lz_fingerprint.Fingerprinter(), []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        p = [own.text(x) for x in (t, edited, after)]
        expected.append(
            (i, n, hashlib.sha256(edited.encode()).hexdigest(), p[0], p[1], lz_fingerprint.likeness(p[0], p[1]), lz_fingerprint.likeness(p[0], p[2]))
        )
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert lz_fingerprint.compare_neighbours(empty(spark)).count() == 0
    one = frame(spark).where("doc_id = 14")
    assert lz_fingerprint.compare_neighbours(one).first()["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in lz_fingerprint.fingerprint_documents(frame(spark)).collect() if r["doc_id"] == 14}
    assert plain[14] == own.text(words(2, 90))


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", min_size=1, max_size=30), st.text("ab cd", max_size=30))
def test_cross_parsing_takes_the_longest_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    assert language_id.count_phrases(text, language_id.suffix_automaton(sample)) == count


LANGUAGES = {"en": "the of and to in that was for with this", "de": "der die und nicht von mit auch sich den ein", "xx": "ko la mi no pu sa ti ve wa yo"}


def speech(lang, seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(n))


def test_language_id_cases(spark):
    data = [(i, speech(lang, i), lang) for i, lang in enumerate(list(LANGUAGES) * 20)]
    labelled = spark.createDataFrame([*data, (900, None, "en"), (901, "the", None), (902, "", "de")], "doc_id long, text string, lang string")
    samples = language_id.sample_texts(labelled, rows=8, chars=2000)
    assert set(samples) == set(LANGUAGES) and all(len(x) <= 2000 for x in samples.values())
    asked = [(2000 + i, speech(lang, 5000 + i, 30).upper() + " 12!", lang) for i, lang in enumerate(list(LANGUAGES) * 10)]
    odd = [(1, None), (2, ""), (3, "123 !! \n"), (4, "\U0001f600"), (None, speech("de", 1))]
    df = spark.createDataFrame([(i, t) for i, t, _ in asked] + odd + odd, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = language_id.identify_language(df, samples).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(asked) + 2 * len(odd)
    assert all(found[i]["lang_pred"] == lang and 0 < found[i]["score"] <= 1 for i, _, lang in asked)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert found[None]["lang_pred"] == "de"
    assert language_id.sample_texts(labelled.limit(0)) == {}
    assert language_id.identify_language(df, {}).where("lang_pred != 'und'").count() == 0
    assert language_id.identify_language(df.limit(0), samples).count() == 0


def test_language_sample_has_its_full_length(spark):
    long = spark.createDataFrame([(k, " ".join(f"wort{k}x{n}" for n in range(900)), "de") for k in range(12)], "doc_id long, text string, lang string")
    assert len(language_id.sample_texts(long)["de"]) == 49_152


def test_stirling_numbers_sum_over_seatings():
    """All seatings of up to 7 customers of one dish, weighted as Chinese restaurants are."""
    d = 0.4
    table = pitman_yor.log_stirling(d, 7)
    for c in range(1, 8):
        weight = {}
        stack = [((1,), 1.0)]
        for _ in range(c - 1):
            stack = [
                x for sizes, w in stack for x in
                [((*sizes[:k], s + 1, *sizes[k + 1 :]), w * (s - d)) for k, s in enumerate(sizes)] + [((*sizes, 1), w)]
            ]
        for sizes, w in stack:
            weight[len(sizes)] = weight.get(len(sizes), 0) + w
        for t, w in weight.items():
            assert math.isclose(math.exp(table[c, t]), w, rel_tol=1e-9)


def test_drawn_tables_follow_the_full_conditional():
    rng, d, theta, p, c, rest = np.random.default_rng(3), 0.5, 1.0, 0.2, 6, 4
    table = pitman_yor.log_stirling(d)
    weight = [math.exp(table[c, t]) * np.prod([theta + d * (rest + k) for k in range(t)]) * p**t for t in range(1, c + 1)]
    many = pitman_yor.draw_tables(np.full(40_000, c), np.full(40_000, rest), np.full(40_000, p), d, theta, rng, table)
    assert np.allclose(np.bincount(many, minlength=c + 1)[1:] / 40_000, np.array(weight) / sum(weight), atol=0.012)
    large = pitman_yor.draw_tables(np.array([1, 0, 10**6]), np.array([0, 0, 5]), np.full(3, 0.01), d, theta, rng, table)
    assert large[0] == 1 and large[1] == 0 and 1 <= large[2] < 10**5


def test_scores_against_brute_force(spark):
    data = [(i, t) for i, t, *_ in rows()]
    train = F.col("doc_id") % 3 != 0
    got = lm_scoring.score_documents(frame(spark), train).collect()
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in data]
    counts = {}
    for i, ws in tokens:
        if i is not None and i % 3 != 0:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), 5))
        for i, ws in tokens
    )
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert found == expected
    assert all(r["score"] < 0 for r in got)
    again = lm_scoring.score_documents(frame(spark), train).collect()
    assert sorted(r["score"] for r in got) == sorted(r["score"] for r in again)
    assert lm_scoring.score_documents(empty(spark), train).count() == 0
    assert all(math.isfinite(r["score"]) for r in lm_scoring.score_documents(frame(spark), F.lit(False)).collect())


def test_predictive_probabilities_sum_to_one():
    """Over all words and the unknown one, for every context, whatever the seating."""
    rng, prior = np.random.default_rng(5), pitman_yor.Prior()
    word, context = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(5), indexing="ij"))
    count = rng.integers(0, 40, len(word)) * (rng.random(len(word)) < 0.5)
    some = count > 0
    model = pitman_yor.Restaurants(word[some], context[some], count[some], 30, 5, prior)
    known = len(set(word[some].tolist()))
    for tables, customers, root in model.sample(1, 1.0, 2, 3):
        full = np.zeros(len(word), np.int64)
        full[some] = tables
        assert (tables >= 1).all() and (tables <= count[some]).all() and (root <= customers).all()
        parent = pitman_yor.parent_probability(customers, root, customers.sum(), root.sum(), known, prior)
        unseen = pitman_yor.parent_probability(0, 0, customers.sum(), root.sum(), known, prior)
        seen = customers > 0
        assert math.isclose(parent[seen].sum() + unseen, 1, rel_tol=1e-9)
        for u in range(5):
            at = context == u
            c, t = count[at].sum(), full[at].sum()
            p = pitman_yor.context_probability(count[at], full[at], c, t, parent[word[at]], prior)
            q = pitman_yor.context_probability(0, 0, c, t, unseen, prior)
            assert math.isclose(p[seen[word[at]]].sum() + q, 1, rel_tol=1e-9)


def test_tables_of_frequent_words_do_not_depend_on_the_owners():
    """Words 0 to 2 are spread over the owners by context, the others have one owner: tables add up to those of one set."""
    rng, prior, words, contexts = np.random.default_rng(7), pitman_yor.Prior(), 4000, 400
    word = np.concatenate([np.repeat(np.arange(3), contexts), np.repeat(np.arange(3, words), 40)])
    context = np.concatenate([np.tile(np.arange(contexts), 3), rng.integers(0, contexts, 40 * (words - 3))])
    count = np.concatenate([rng.integers(4, 30, 3 * contexts), rng.integers(1, 4, 40 * (words - 3))])
    spread, deal = np.arange(words) < 3, rng.integers(0, 1 << 30, len(word))

    def tables(owners):
        owner, sums = np.where(spread[word], deal, word) % owners, np.zeros((3, 3))
        for k in range(owners):
            own = owner == k
            model = pitman_yor.Restaurants(word[own], context[own], count[own], words, contexts, prior, spread)
            for s, (drawn, _, _) in enumerate(model.sample(k + 1, float(owners), 2, 3)):
                sums[s] += [drawn[word[own] == w].sum() for w in range(3)]
        return sums.mean()

    one = tables(1)
    assert all(abs(tables(owners) / one - 1) < 0.08 for owners in (4, 12))


def test_model_learns_word_order(spark):
    """Held-out text of the same pairs is more likely under the model than under the base; shuffled text less so."""
    def text(seed, n=60):
        rng = random.Random(seed)
        return " ".join(rng.choice(["red car", "blue sky", "green tree", "old man"]) for _ in range(n))

    data = [(i, text(i)) for i in range(60)]
    mixed = text(99).split()
    random.Random(1).shuffle(mixed)
    data += [(100, text(99)), (101, " ".join(mixed))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, F.col("doc_id") < 60).collect()}
    assert got[100]["score"] > got[100]["base_score"] + 10
    assert got[101]["score"] < got[100]["score"] - 10 and math.isclose(got[101]["base_score"], got[100]["base_score"])


def test_contexts_are_not_merged(spark):
    """Two words that shared one of 65,536 restaurants before: what follows the one says nothing of what follows the other."""
    seen, pair = {}, None
    for k in range(4000):
        word = f"word{k}"
        data = np.frombuffer(word.encode(), np.uint8)
        hashes, _ = hashing.word_hashes(data, np.array([0, len(data)]))
        key = int(hashing.mix64(hashes ^ np.uint64(0x6C62272E07BB0142))[0]) >> 48
        if key in seen:
            pair = seen[key], word
            break
        seen[key] = word
    one, other = pair
    data = [(i, f"{one} red") for i in range(40)] + [(40 + i, f"{other} blue") for i in range(40)]
    data += [(100, f"{one} red"), (101, f"{one} blue")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(df, F.col("doc_id") < 80).collect()}
    assert got[100] > got[101] + 1
    keys = np.arange(1 << 17, dtype=np.uint64)
    assert len(np.unique(lm_scoring.context_of(keys))) == len(keys)


def test_contexts_get_the_sums_of_all_owners():
    """Three owners, of which each has some of the contexts; sums come back in each owner's order."""
    def packed(contexts, *sums):
        return np.array(contexts, "<u8").tobytes(), lm_scoring._squeezed(np.array(sums, "<u4"))

    top = 2**64 - 1
    rows = [(0, *packed([1, 7, top], [5, 0, 2], [3, 0, 1])), (4, *packed([7], [9], [4])), (2, *packed([1, top], [2**32 - 1, 1], [1, 1]))]
    out = lm_scoring._summed(1)(pd.DataFrame(rows, columns=["owner", "contexts", "sums"]).assign(k=3))
    got = {o: lm_scoring._unsqueezed(x, "<i8", (2, n)).tolist() for o, n, x in zip(out["owner"], out["n"], out["sums"])}
    assert got == {0: [[2**32 + 4, 9, 3], [4, 4, 2]], 4: [[9], [4]], 2: [[2**32 + 4, 3], [4, 2]]}


def test_scores_at_many_owners(spark, monkeypatch):
    """Without words that occur twice after one context all tables are known, and scores don't depend on the owners."""
    data = [(i, f"a{i} b{i} c{i} a{i + 1}") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")

    def scores(owners):
        monkeypatch.setattr(lm_scoring, "LEAST_OWNERS", owners)
        return {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(df, F.col("doc_id") % 3 != 0, owner_bytes=1 << 20).collect()}

    one, many = scores(1), scores(12)
    assert len(one) == len(many) == 30
    assert all(abs(many[k] / one[k] - 1) < 0.01 for k in one)
