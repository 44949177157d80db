"""Distributed exact median vs Spark's exact percentile and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import quantiles
from shelfcast.operators.quantiles import column_medians, grouped_median


def test_grouped_median_matches_exact_percentile_with_hot_group(spark):
    rng = np.random.default_rng(11)
    rows = [("hot", float(x)) for x in np.round(rng.normal(50, 20, 3000), 2)]
    rows += [(f"g{i}", float(x)) for i in range(20) for x in np.round(rng.uniform(0, 9, i + 1), 0)]  # ties, odd/even sizes
    rows += [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.median for r in grouped_median(df, ["g"], "v").collect()}
    exp = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert set(got) == set(exp)
    for k in exp:
        assert got[k] == pytest.approx(exp[k], abs=1e-9)


def test_column_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None)], "a double, b double")
    m = column_medians(df, ["a", "b"])
    assert m["a"] == 2.5 and m["b"] is None


@pytest.mark.parametrize("reuse", ["true", "false"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_two_large_groups_over_several_cuts(spark, monkeypatch, reuse, adaptive):
    """2M rows in two groups, whatever the physical plan; small cells force several rounds of cuts."""
    monkeypatch.setattr(quantiles, "CELL_VALUES", 5_000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.range(0, 2_000_000, 1, 16).select(
            (F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 1_000_003 - F.col("id") % 5000).cast("double").alias("v")
        )
        got = {r.g: r.median for r in grouped_median(df, ["g"], "v").collect()}
        exp = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
        assert got == exp
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_column_medians_of_many_rows_and_ties(spark):
    df = spark.range(0, 50_001, 1, 8).select(
        F.col("id").cast("double").alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") % 11).alias("b"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("c"),
    )
    exp = df.agg(F.median("a"), F.median("b"), F.median("c")).first()
    assert list(column_medians(df, ["a", "b", "c"]).values()) == list(exp)
