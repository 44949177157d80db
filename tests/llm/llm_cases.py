"""Documents with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, key string, block long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "délta", "of", "the", "a", f"w{rng.randrange(400)}"]) for _ in range(n))


def rows():
    base = words(1, 120)
    near = base.replace("alpha", "omega", 1)
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One two"), (6, "one TWO"),
        (10, base), (11, base.upper()), (12, near), (13, base), (14, words(2, 90)),
        (20, words(3, 60) + "\n" + base + "\n" + words(4, 70)), (21, words(5, 55) + "\n" + base),
        (22, "É é " + base), (23, "x" * 5000), (24, words(6, 20_000)), (25, "\n\n" + base + "\n\n"),
        (26, " lead  double space nbsp 's 'll don't <|endoftext|> 12345 \U0001f600 "), (27, "　  a b"),
        (30, words(7, 80)), (30, words(7, 80)), (31, words(8, 80)), (31, words(9, 80)),
        (None, base), (None, None), (None, words(10, 60)),
    ]
    return [(i, t, "en", "s", 0 if t is None else len(t), 7, 7, "k", 7) for i, t in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
