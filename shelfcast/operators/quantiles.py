"""Exact, skew-safe grouped median (interpolated like pandas / Spark ``median``).

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so a group holding a third of 100 TB would land in one
task. Here values are first collapsed to (group, value, weight) by a partial
aggregate. While a cell that holds a wanted rank has more than ``CELL_VALUES``
values, it is cut by value bounds (approximate percentiles, written once so
every later plan sees the same ones), weights are summed per bucket, and only
the buckets that hold a wanted rank go on. What is left is ranked by a window
per cell. Bounds decide only where cells are cut, never the result.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.session import materialize

#: Distinct values that one task ranks at most.
CELL_VALUES = 1_000_000
#: Buckets a cell is cut into.
BUCKETS = 64


def _selected(weights: DataFrame, wanted: DataFrame, g: list[str], alias: str) -> DataFrame:
    """Mean of the values at the wanted ranks of each group.

    ``weights``: (*g, _cell, _v, _w); ``wanted``: (*g, _cell, _pos), ranks counted
    from 0 inside the cell.
    """
    keys = [*g, "_cell"]
    while True:
        held = weights.join(wanted.select(*keys).distinct(), keys, "left_semi")
        largest = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
        if largest <= CELL_VALUES:
            break
        cuts = [i / BUCKETS for i in range(1, BUCKETS)]
        bounds = materialize(
            held.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 100 * BUCKETS).alias("_bounds")), "median-bounds"
        )
        bucket = F.size(F.filter("_bounds", lambda b: b <= F.col("_v"))).cast("long")
        placed = held.join(bounds, keys).withColumn("_bucket", bucket)
        sums = placed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_c"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        hit = (F.col("_start") <= F.col("_pos")) & (F.col("_pos") < F.col("_start") + F.col("_c"))
        inner = (F.col("_cell") * (BUCKETS + 1) + F.col("_bucket")).alias("_cell")
        wanted = materialize(
            wanted.join(sums, keys).filter(hit).select(*g, inner, (F.col("_pos") - F.col("_start")).alias("_pos")),
            "median-cells",
        )
        weights = materialize(
            placed.select(*g, inner, "_v", "_w").join(wanted.select(*keys).distinct(), keys, "left_semi"), "median-values"
        )
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("_end", F.sum("_w").over(upto)).join(wanted, keys)
    hit = (F.col("_end") - F.col("_w") <= F.col("_pos")) & (F.col("_pos") < F.col("_end"))
    lo, hi = F.min("_v"), F.max("_v")
    return ranked.filter(hit).groupBy(*g).agg((lo + (hi - lo) * F.lit(0.5)).alias(alias))


def _weights(values: DataFrame, g: list[str]) -> DataFrame:
    weights = values.filter(F.col("_v").isNotNull()).groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_w"))
    return weights.select(*g, F.lit(0).cast("long").alias("_cell"), "_v", "_w")


def grouped_median(df: DataFrame, group: Sequence[str], value: str, alias: str = "median") -> DataFrame:
    """(*group, alias): exact median of non-null ``value`` per group; groups with no
    values are absent. Position (n-1)/2, linear interpolation between neighbours."""
    g = list(group)
    weights = _weights(df.select(*g, F.col(value).cast("double").alias("_v")), g)
    n = weights.groupBy(*g, "_cell").agg(F.sum("_w").alias("_n"))
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)))
    return _selected(weights, n.select(*g, "_cell", F.explode(middle).alias("_pos")), g, alias)


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column.

    One aggregate brackets every column's middle by approximate percentiles, a
    second counts what lies below each bracket; only values inside it (some
    percent) are unpivoted and ranked.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    near = df.agg(*[F.percentile_approx(value[c], [0.48, 0.52], 1000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    known = [(i, c) for i, c in enumerate(columns) if near[f"q{i}"]]
    if not known:
        return {c: None for c in columns}
    counted = []
    for i, c in known:
        lo, hi = near[f"q{i}"]
        counted += [
            F.count(value[c]).alias(f"n{i}"),
            F.count_if(value[c] < lo).alias(f"b{i}"),
            F.count_if(value[c].between(lo, hi)).alias(f"m{i}"),
        ]
    row = df.agg(*counted).first()
    wanted, inside = [], []
    for i, c in known:
        (lo, hi), below, middle = near[f"q{i}"], row[f"b{i}"], (row[f"n{i}"] - 1) / 2
        ranks = sorted({math.floor(middle), math.ceil(middle)})
        held = F.lit(True)
        if below <= ranks[0] and ranks[-1] < below + row[f"m{i}"]:
            held = value[c].between(lo, hi)
            ranks = [r - below for r in ranks]
        wanted += [(c, 0, r) for r in ranks]
        inside.append(F.when(held & value[c].isNotNull(), F.struct(F.lit(c).alias("column"), value[c].alias("_v"))))
    long = df.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).select("x.*")
    places = df.sparkSession.createDataFrame(wanted, "column string, _cell long, _pos long")
    got = {r.column: r.median for r in _selected(_weights(long, ["column"]), places, ["column"], "median").collect()}
    return {c: got.get(c) for c in columns}
