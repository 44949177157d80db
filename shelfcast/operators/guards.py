"""Forecast-window, training, cutoff and leakage guards.

Each guard is a rule set evaluated by ``contracts.audit`` (one aggregate
pass) plus at most one small grouped aggregate; ``enforce`` raises.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if, day_of_week_iso
from shelfcast.operators.contracts import ContractError, audit, forbid_columns, require_columns
from shelfcast.operators.splits import pair_horizon


def window_row_rules(cutoff: dt.date, horizon: int = S.FORECAST_HORIZON_DAYS) -> dict[str, Column]:
    """The rules of V4 that one row can break."""
    first, last = cutoff + dt.timedelta(days=1), cutoff + dt.timedelta(days=horizon)
    d = F.col("date")
    known = S.CATEGORICAL_FEATURES + ["onpromotion"] + S.HOLIDAY_FEATURE_COLUMNS
    return {
        "null_base_key": F.greatest(*[F.col(k).isNull() for k in S.BASE_KEY]),
        "null_id": F.col("id").isNull(),
        "date_outside_window": ~d.between(F.lit(first), F.lit(last)),
        "missing_known_context": F.greatest(*[F.col(c).isNull() for c in known]),
        "month_mismatch": F.col("month") != F.month(d),
        "day_of_month_mismatch": F.col("day_of_month") != F.dayofmonth(d),
        "day_of_week_mismatch": F.col("day_of_week") != day_of_week_iso(d),
    }


def window_rules(future: DataFrame, cutoff: dt.date, horizon: int = S.FORECAST_HORIZON_DAYS) -> DataFrame:
    """V4: the future batch is exactly the ``horizon`` days after ``cutoff``, complete per pair."""
    require_columns(future, S.MODEL_FEATURES + ["id", "date"], "future batch", exact=False)
    forbid_columns(future, ["sales"], "future batch")
    first = cutoff + dt.timedelta(days=1)
    last = cutoff + dt.timedelta(days=horizon)
    d = F.col("date")
    rows = audit(
        future,
        window_row_rules(cutoff, horizon),
        unique={"duplicate_base_key": S.BASE_KEY, "duplicate_id": ["id"]},
        non_empty=True,
    )
    dates = future.agg(
        (F.lit(horizon) - F.countDistinct(F.when(d.between(F.lit(first), F.lit(last)), d))).cast("long").alias("v")
    ).select(F.lit("missing_window_dates").alias("rule"), F.col("v").alias("violations"))
    pairs = pair_horizon(future).agg(count_if(F.col("forecast_dates") != horizon).alias("v")).select(
        F.lit("incomplete_pairs").alias("rule"), F.col("v").alias("violations")
    )
    return rows.unionByName(dates).unionByName(pairs)


def training_rules(train: DataFrame) -> DataFrame:
    """V5: model features present; sales complete and non-negative."""
    require_columns(train, S.MODEL_FEATURES + ["sales"], "training data", exact=False)
    return audit(train, {"invalid_sales": F.col("sales").isNull() | (F.col("sales") < 0)}, non_empty=True)


def cutoff_rules(history: DataFrame, cutoff: dt.date) -> DataFrame:
    """V9: the history ends exactly at the training cutoff."""
    mx = F.max("date")
    return history.agg(
        F.when(mx.isNull() | (mx != F.lit(cutoff)), 1).otherwise(0).cast("long").alias("v"),
        count_if(F.col("date") > F.lit(cutoff)).alias("after"),
    ).select(
        F.explode(F.array(
            F.struct(F.lit("history_end_differs").alias("rule"), F.col("v").alias("violations")),
            F.struct(F.lit("rows_after_cutoff").alias("rule"), F.col("after").alias("violations")),
        )).alias("x")
    ).select("x.*")


def leakage_rules(oil_lookup: DataFrame, future: DataFrame, cutoff: dt.date, windows: DataFrame) -> DataFrame:
    """No as-of match after its reference date, no lag source after the cutoff,
    every evaluation window lag-safe."""
    neg_age = F.greatest(*[F.col(c) < 0 for c in S.OIL_AGE_COLUMNS])
    a = audit(oil_lookup, {"future_oil_match": neg_age})
    b = audit(future, {"lag_source_after_cutoff": F.date_sub("date", min(S.SAFE_LAGS)) > F.lit(cutoff)})
    c = audit(windows, {"window_not_lag_safe": ~F.col("all_lags_available_by_cutoff")})
    return a.unionByName(b).unionByName(c)


def raise_if(audit_df: DataFrame, context: str) -> None:
    bad = [(r.rule, r.violations) for r in audit_df.collect() if r.violations]
    if bad:
        raise ContractError(f"{context}: " + ", ".join(f"{k}={v}" for k, v in sorted(bad)))
