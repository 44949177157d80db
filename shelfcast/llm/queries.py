"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    byte_bpe,
    exact_dedup,
    html_extract,
    language_id,
    lexical_search,
    lm_scoring,
    lz_fingerprint,
    minhash_dedup,
    packing,
    paragraph_dedup,
    suffix_dedup,
    token_scan,
    tokens,
    word_runs,
)
from shelfcast.llm.scratch import Scratch

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
#: The first id that the rank files leave free.
END_ID = 50_256


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_VOCABULARY)
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokens.WordEncoder, path)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(_table(spark, sf_dir, "documents"), width=3, least=85)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, pattern, decode=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_neighbours(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    samples = language_id.sample_texts(docs.where(~held_out))
    found = language_id.identify_language(docs, samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    args = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    files = token_scan.token_files(docs, tokens.RankEncoder, *args, end_id=END_ID)
    with Scratch(spark) as tmp:
        files = tmp.write(files, "token-files", keep=True)
    counts = token_scan.token_counts(files, END_ID)
    return counts.where("terminated").select("doc_id", "n_tokens")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = lm_scoring.score_documents(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_strings(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a hash of the id, the words from some place on
    are replaced by repetitions of the first of them. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = F.expr("""
        array_join(transform(words, (w, i) -> if(i < g % size(words), w,
          words[cast(g % size(words) + (i - g % size(words)) % (1 + (size(words) - g % size(words)) div (3 + g % 8)) as int)])), ' ')
    """)
    edited = (F.col("h") % 10 == 0) & (F.size("words") > 0)
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    return chosen.select("doc_id", F.when(edited, tail).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_runs.find_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))
    # Lengths and periods are below 2**53, so a quotient of two is the same double only if it is the same number
    # or both are beyond 2**26 words; ties go to the smaller start, then period.
    best = F.expr("""
        array_min(transform(runs, r -> named_struct(
          'least', -(r.length / r.period), 'start', r.start, 'period', r.period, 'length', r.length)))
    """)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lz_fingerprint": op6_lz_fingerprint,
    "op7_language_id": op7_language_id,
    "op8_token_counts": op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": """
        WITH t AS (
          SELECT doc_id,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
          FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY body) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
               sha256(body) AS text_sha256
        FROM t
    """,
    "op11_lexical_search": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents
        ), q AS (
          SELECT item_id, unnest(regexp_extract_all(
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
          FROM benchmark
        ), bags AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        totals AS (SELECT count(*) AS docs, sum(len(terms)) AS terms FROM d WHERE len(terms) > 0),
        words AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        tf AS (
          SELECT doc_id, n, term, count(*) AS tf FROM words
          WHERE term IN (SELECT term FROM bags) GROUP BY ALL
        ), weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM tf, totals GROUP BY term, docs
        ), parts AS (
          SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf
                   + 12 * (100 - 25 + CAST((25 * n * docs) // terms AS BIGINT)))) AS part
          FROM tf JOIN weights USING (term), totals
        ), scores AS (
          SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score
          FROM bags JOIN parts USING (term) GROUP BY item_id, doc_id
        ), ranked AS (
          SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
                 doc_id, score
          FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_suffix_dedup": """
        WITH raw AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
        pieces AS (
          SELECT r, k, substr(h, 2000 * k + 1, 2798) AS piece
          FROM (SELECT r, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM raw)
        ), windows AS (
          SELECT r, 1000 * k + i AS pos, md5(substr(piece, 2 * i + 1, 800)) AS w
          FROM (SELECT r, k, piece, unnest(range(0, length(piece) // 2 - 399)) AS i FROM pieces WHERE length(piece) >= 800)
        ), twice AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        starts AS (
          SELECT r, pos, coalesce(pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) > 400, true) AS new
          FROM windows WHERE w IN (SELECT w FROM twice)
        ), numbered AS (SELECT r, pos, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY pos) AS k FROM starts),
        spans AS (SELECT r, k, min(pos) AS a, max(pos) + 400 AS b FROM numbered GROUP BY r, k),
        gaps AS (
          SELECT r, k, h, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS low, a AS high FROM spans JOIN raw USING (r)
          UNION ALL SELECT r, 1000000000, h, max(b), length(h) // 2 FROM spans JOIN raw USING (r) GROUP BY r, h
        ), kept AS (SELECT r, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY k) AS h FROM gaps GROUP BY r)
        SELECT doc_id, CAST(length(raw.h) // 2 AS BIGINT) AS n_bytes,
          CAST(length(raw.h) // 2 - length(coalesce(kept.h, raw.h)) // 2 AS BIGINT) AS n_removed,
          CAST((SELECT count(*) FROM spans WHERE spans.r = raw.r) AS BIGINT) AS n_spans,
          sha256(unhex(coalesce(kept.h, raw.h))) AS kept_sha256
        FROM raw LEFT JOIN kept USING (r)
    """,
    "op13_periodic_runs": r"""
        WITH hashed AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            xor(4294967295, list_reduce(
              list_prepend(4294967295, flatten([[CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                                FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
              lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END
            )) AS h
          FROM documents
        ), sized AS (
          SELECT doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS edited, h // 10 AS g,
                 CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a
          FROM hashed
        ), shaped AS (SELECT *, CASE WHEN edited THEN 1 + (n - a) // (3 + g % 8) END AS p FROM sized),
        docs AS (
          SELECT row_number() OVER () AS r, doc_id, n,
            CASE WHEN edited THEN [words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(0, n)] ELSE words END AS words
          FROM shaped
        ), shifts AS (SELECT r, words, n, unnest(range(1, n // 4 + 1)) AS q FROM docs),
        equal AS (
          SELECT r, q, unnest(list_filter(range(0, n - q), lambda i: words[i + 1] = words[i + q + 1])) AS i FROM shifts
        ), islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
        stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island),
        runs AS (
          SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
        ), best AS (
          SELECT r, start, length, period FROM runs
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1
        ), listed AS (
          SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS body
          FROM runs GROUP BY r
        ), dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (
          SELECT w.r, string_agg(word, ' ' ORDER BY i) AS body
          FROM (SELECT r, unnest(words) AS word, unnest(range(0, n)) AS i FROM docs) w
          WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.r = w.r AND d.i = w.i) GROUP BY w.r
        )
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, start, length, period,
               CAST(1000 * length // period AS BIGINT) AS exponent_milli,
               sha256(coalesce(listed.body, '')) AS runs_sha256, sha256(coalesce(kept.body, '')) AS collapsed_sha256
        FROM docs LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
    """,
}
