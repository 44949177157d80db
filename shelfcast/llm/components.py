"""Connected components by alternating large-star and small-star steps.

Each step is grouping and joining of edge rows; edges stay in written tables
and only two numbers per round reach the driver. A hub's edges may be a large
share of all: minima are combined before the shuffle and stored, so the join
back has two plain shuffled sides, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.scratch import Scratch


#: Edges that a task handles, about.
TASK_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Edges with a null end or equal ends link nothing and are left out.
    """
    with Scratch(edges.sparkSession) as tmp:

        def write(df: DataFrame, name: str) -> DataFrame:
            # As many tasks as the edges of the last round ask for: rounds on few edges are short.
            return tmp.write(df.coalesce(1 + state[0] // TASK_EDGES), name)

        e = tmp.write(
            edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
            "edges",
        )
        state = _state(e)
        while state[0]:
            # Large star: each node hands its larger neighbours the smallest id around it.
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = write(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
            e = write(
                both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
            )
            # Small star: each node hands its smaller neighbours, and itself, the smallest of them.
            low = write(e.groupBy("u").agg(F.min("v").alias("m")), "low")
            moved = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = write(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
            before, state = state, _state(e)
            if before == state:
                break
        roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
        return tmp.write(
            e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components", keep=True
        )
