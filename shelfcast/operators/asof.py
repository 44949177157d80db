"""As-of joins of event-grain series with many keys (J3 beyond the day grain).

For each left row the last right row of its key at or before its time. Both
sides are put together and cut into ranges of (key, time), so a key that holds a
third of all rows spreads over many tasks. The ranges are written once; in each,
a running last value answers the rows, and what a range can't see is carried
over its edge: the last observation of the ranges before it, one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.session import materialize

#: Rows of a range, on average.
RANGE_ROWS = 1_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    tie: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``left`` with the ``values`` (renamed nothing) and ``matched_time`` of the last row of ``right`` with equal
    ``keys`` and a ``time`` not after the left row's; nulls where there is none.

    Of right rows with equal key and time the one with the greatest ``tie`` counts (else any). Rows of ``right``
    with a null time, and of either side with a null key, match nothing; left rows are all kept, also
    repeated ones. Values may be null themselves: the last row counts, whatever it holds.
    """
    spark, order = left.sparkSession, [f"_k{i}" for i in range(len(keys))]
    payload = F.struct(*[F.col(v) for v in values], F.col(time).alias("matched_time"))
    named = [F.col(k).alias(n) for k, n in zip(keys, order)]
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    observed = right.where(known & F.col(time).isNotNull()).select(
        *named, F.col(time).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None).cast("long")).alias("_tie"),
        payload.alias("_seen"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"),
    )
    asked = left.select(
        *named, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(observed.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(observed.schema["_seen"].dataType).alias("_seen"), F.struct(*left.columns).alias("_row"),
    )
    both = observed.unionByName(asked)
    # Rows that are equal so far may fall into several ranges: a hash of the row parts them.
    place = [*order, "_t", "_side", "_tie", F.xxhash64("_row", "_seen")]
    ranges = max(1, both.count() // range_rows + 1)
    dealt = both.repartitionByRange(ranges, *place).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "asof-ranges")

    edges = dealt.where("_side = 0").groupBy("_range").agg(
        F.max_by(F.struct(*order, "_seen"), F.struct(*order, "_t", "_tie")).alias("_last")
    )
    carried = _carry(spark, sorted(edges.collect()), edges.schema["_last"].dataType, ranges)
    within = Window.partitionBy("_range", *order).orderBy("_t", "_side", F.asc_nulls_first("_tie"))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumn("_found", F.last("_seen", ignorenulls=True).over(within)).where("_side = 1")
    same = F.col("_t").isNotNull()
    for n in order:
        same = same & (F.col(f"_last.{n}") == F.col(n))
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_found", F.when(same, F.col("_last._seen"))))
    out = running.join(carried, "_range").select("_row", found.alias("_found"))
    return out.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in [*values, "matched_time"]])


def _carry(spark, edges: list, kind: T.DataType, ranges: int) -> DataFrame:
    """(_range, _last): for each range the last observation of all ranges before it. One row a range."""
    rows, last = [], None
    by_range = {e._range: e._last for e in edges}
    for k in range(ranges):
        rows.append((k, last))
        last = by_range.get(k, last)
    return spark.createDataFrame(rows, T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_last", kind)]))
