"""As-of joins over many keys and uniqueness of dense ids, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import contracts as C
from shelfcast.operators.asof import asof_join

LEFT, RIGHT = "id int, k string, z int, t long", "k string, z int, t long, v double, seq int"


def brute(left, right):
    out = []
    for i, k, z, t in left:
        seen = [(rt, seq, v) for rk, rz, rt, v, seq in right if None not in (k, z, t, rk, rz, rt) and (rk, rz) == (k, z) and rt <= t]
        time, _, value = max(seen, key=lambda s: s[:2]) if seen else (None, None, None)
        out.append((i, k, z, t, value, time))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_rows", [1_000_000, 25])
def test_asof_equals_brute_force(spark, range_rows):
    """Ties, gaps, null keys, times and values, repeated rows, and a key that holds half of all rows."""
    for seed in range(2):
        rng = random.Random(seed)

        def key():
            return ("hot", 1) if rng.random() < 0.5 else (rng.choice(["a", "b", None]), rng.choice([1, 2, None]))

        left = [(i, *key(), rng.choice([rng.randrange(60), None]) if i % 9 == 0 else rng.randrange(60)) for i in range(150)]
        left += left[:5]
        right = [(*key(), None if s % 31 == 0 else rng.randrange(60), None if s % 7 == 0 else rng.random(), s) for s in range(120)]
        found = asof_join(
            spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(3),
            ["k", "z"], "t", ["v"], tie="seq", range_rows=range_rows,
        )
        assert found.columns == ["id", "k", "z", "t", "v", "matched_time"]
        assert sorted(map(tuple, found.collect()), key=repr) == brute(left, right)


def test_asof_of_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 1, 5)], LEFT), spark.createDataFrame([("a", 1, 4, 2.0, 0)], RIGHT)
    assert asof_join(left, right.where("t > 9"), ["k", "z"], "t", ["v"]).collect()[0].v is None
    assert asof_join(left.where("id > 9"), right, ["k", "z"], "t", ["v"]).collect() == []


def test_no_range_holds_a_hot_key(spark):
    rows = [(i, "hot", 1, i % 400) for i in range(4000)]
    left = spark.createDataFrame(rows, LEFT)
    right = spark.createDataFrame([("hot", 1, 17 * k, float(k), k) for k in range(24)], RIGHT)
    found = asof_join(left, right, ["k", "z"], "t", ["v"], range_rows=250)
    wrong = found.where(F.col("v") != F.floor(F.least(F.col("t"), F.lit(391)) / 17)).count()
    assert wrong == 0 and found.count() == 4000
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def shuffled(df):
    """Bytes written by the exchanges of a collected plan."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName() == "ShuffleQueryStageExec":
            plans.append(plan.plan())
            continue
        if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleBytesWritten").value()
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return total


@pytest.mark.parametrize("start", [0, -50_000, 1 << 40])
def test_dense_ids_by_bitmaps(spark, start):
    clean = spark.range(start, start + 300_000, numPartitions=4).toDF("id")
    dirty = clean.unionByName(clean.where("id % 1000 = 7")).unionByName(clean.where("id % 1000 = 7")).unionByName(
        spark.createDataFrame([(None,)] * 3, "id long")
    )
    again = clean.where("id % 1000 = 7").count()
    for df, extra in ((clean, 0), (dirty, 2 * again + 2)):
        by_bitmap, by_group = C.duplicate_ids(df, "id"), C.duplicate_counts(df, ["id"])
        assert by_bitmap.first().extra_rows == by_group.first().extra_rows == extra
        assert 10 * shuffled(by_bitmap) <= shuffled(by_group)


def test_sparse_and_missing_ids_are_grouped(spark):
    sparse = spark.range(2000).select((F.col("id") % 1990 * 10_000_000).alias("id"))
    for df, extra in ((sparse, 10), (sparse.where("id < 0"), 0), (spark.createDataFrame([(None,)] * 4, "id int"), 3)):
        found = C.duplicate_ids(df, "id")
        assert found.first().extra_rows == extra and "bitmap" not in found._jdf.queryExecution().toString()
