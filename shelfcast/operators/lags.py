"""Exact-key calendar lags (J4, J5) and backward as-of lags.

Exact lag: the value at exactly ``date - lag`` for the same keys; a missing
history row stays missing (never carried forward). Built as ONE shuffle of
the history: each history row is exploded forward to its ``date + lag``
targets, pivoted by conditional ``max`` under partial aggregation, and
left-joined to the base on the full key. The pivot output is already hash
partitioned on that key, so the join only shuffles the base side.

As-of lag: the last non-null observation on or before ``date - lag`` plus its
age in days. On a day grain the observations are densified into one row per
covered day (``[d, next_d)``) and the lookup becomes a plain equi-join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.columns import nonnull_count
from shelfcast.operators.contracts import ContractError, duplicate_counts


def _lag_names(prefix: str, lags: Sequence[int]) -> list[str]:
    return [f"{prefix}_lag_{lag}" for lag in lags]


def exact_lag_lookup(
    history: DataFrame,
    keys: Sequence[str],
    value: str,
    lags: Sequence[int],
    prefix: str,
    date_col: str = "date",
    count_col: str | None = None,
) -> DataFrame:
    """Lookup table keyed by (target date, *keys) with one column per lag."""
    lag_arr = F.array(*[F.lit(int(lag)) for lag in lags])
    fwd = history.select(
        F.col(date_col).alias("_src"), *keys, F.col(value).alias("_v"), F.explode(lag_arr).alias("_lag")
    ).select(F.date_add("_src", F.col("_lag")).alias(date_col), *keys, "_lag", "_v")
    names = _lag_names(prefix, lags)
    aggs = [F.max(F.when(F.col("_lag") == lag, F.col("_v"))).alias(n) for lag, n in zip(lags, names)]
    out = fwd.groupBy(date_col, *keys).agg(*aggs)
    if count_col:
        out = out.withColumn(count_col, nonnull_count(names))
    return out


def exact_lags(
    base: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    value: str,
    lags: Sequence[int],
    prefix: str,
    date_col: str = "date",
    count_col: str | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Attach exact calendar lags of ``history[value]`` to ``base``.

    History must be unique on (date, *keys); that is checked with one
    aggregate (``check_unique``), which also proves the join is many-to-one.
    """
    # Only history dates some target can reach are exploded (a pushed-down range
    # filter): scoring a 16-day batch touches 35 days of history, not all of it.
    span = base.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    if span.lo is not None:
        history = history.filter(F.col(date_col).between(
            F.date_sub(F.lit(span.lo), max(lags)), F.date_sub(F.lit(span.hi), min(lags))
        ))
    if check_unique:
        extra = duplicate_counts(history, [date_col, *keys]).first().extra_rows
        if extra:
            raise ContractError(f"{prefix} history must be unique by {[date_col, *keys]} ({extra} extra rows).")
    lookup = exact_lag_lookup(history, keys, value, lags, prefix, date_col)
    names = _lag_names(prefix, lags)
    out = base.join(lookup, [date_col, *keys], "left").select(*base.columns, *names)
    if count_col:
        out = out.withColumn(count_col, nonnull_count(names))
    return out


def asof_lookup(
    dates: DataFrame,
    series: DataFrame,
    lags: Sequence[int],
    prefix: str,
    value: str,
    date_col: str = "date",
    source_date_col: str = "date",
) -> DataFrame:
    """Backward as-of lags for a single day-grain series.

    ``dates``: distinct target dates. ``series``: one row per source date
    (unique, checked by the caller). Null values are dropped first, so the
    match is the last *published* value. The densified table has one row per
    calendar day between the first observation and the last target date, so it
    is bounded by the calendar span, not by the fact-table size; its
    ``lead`` runs over that day-grain series only.
    """
    obs = series.select(F.col(source_date_col).alias("_src"), F.col(value).alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    max_target = dates.agg(F.max(date_col)).first()[0]
    w = Window.orderBy("_src")
    spans = obs.withColumn("_next", F.lead("_src").over(w))
    # The last observation covers every day up to the latest target date.
    last_day = F.lit(max_target).cast("date") if max_target is not None else F.col("_src")
    spans = spans.withColumn(
        "_end", F.coalesce(F.date_sub("_next", 1), F.greatest(last_day, F.col("_src")))
    )
    dense = spans.select(
        F.explode(F.sequence("_src", "_end")).alias("_ref"), "_src", "_v"
    ).filter(F.col("_ref").isNotNull())
    # Each covered day serves one target date a lag: one pivot, then one join.
    place = F.explode(F.array(*[F.struct(F.lit(int(lag)).alias("lag")) for lag in lags])).alias("p")
    served = dense.select("*", place).select(
        F.date_add("_ref", F.col("p.lag")).alias(date_col), F.col("p.lag").alias("_lag"),
        F.struct(F.col("_v").alias("v"), F.datediff("_ref", "_src").cast("int").alias("age")).alias("_found"),
    )
    held = served.groupBy(date_col).agg(*[F.max(F.when(F.col("_lag") == lag, F.col("_found"))).alias(f"_{lag}") for lag in lags])
    out = dates.select(date_col).distinct().join(held, date_col, "left")
    for lag in lags:
        name = f"{prefix}_lag_{lag}"
        out = out.withColumns({name: F.col(f"_{lag}.v"), f"{name}_age_days": F.col(f"_{lag}.age")})
    names = [f"{prefix}_lag_{lag}" for lag in lags]
    ages = [f"{n}_age_days" for n in names]
    return out.select(date_col, *names, *ages)
