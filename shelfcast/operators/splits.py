"""Chronological splits and their audits."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import all_not_null, count_if
from shelfcast.operators.contracts import ContractError

SPLIT_ORDER = ["train", "validation", "internal_test", "unassigned"]


@dataclass(frozen=True)
class Windows:
    train_end: dt.date
    validation_start: dt.date
    validation_end: dt.date
    internal_test_start: dt.date
    internal_test_end: dt.date
    future_start: dt.date
    future_end: dt.date


def date_window(df: DataFrame, start: dt.date, end: dt.date, date_col: str = "date") -> DataFrame:
    """P5: inclusive on both ends."""
    return df.filter(F.col(date_col).between(F.lit(start), F.lit(end)))


def chrono_split(df: DataFrame, w: Windows, date_col: str = "date") -> DataFrame:
    """data_split in train / validation / internal_test / unassigned."""
    d = F.col(date_col)
    label = (
        F.when(d.between(F.lit(w.internal_test_start), F.lit(w.internal_test_end)), "internal_test")
        .when(d.between(F.lit(w.validation_start), F.lit(w.validation_end)), "validation")
        .when(d <= F.lit(w.train_end), "train")
        .otherwise("unassigned")
    )
    return df.withColumn("data_split", label)


def split_counts(split_df: DataFrame, date_col: str = "date") -> DataFrame:
    """Rows and observed dates per split, empty splits included.

    Rows collapse to one for each (split, date) first, so dates are counted without expanding rows.
    """
    daily = split_df.groupBy("data_split", date_col).agg(F.count(F.lit(1)).alias("n"))
    found = daily.groupBy("data_split").agg(F.sum("n").alias("rows"), F.count(date_col).alias("observed_dates"))
    order = split_df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPLIT_ORDER)], "data_split string, split_rank int")
    zero = F.lit(0).cast("long")
    return order.join(found, "data_split", "left").select(
        "data_split", "split_rank", F.coalesce("rows", zero).alias("rows"), F.coalesce("observed_dates", zero).alias("observed_dates")
    )


def split_rules(split_df: DataFrame, w: Windows, date_col: str = "date") -> DataFrame:
    """P7 as a contract (rule, violations): no row without a split, every date of both windows observed."""
    found = {r.data_split: r for r in split_counts(split_df, date_col).collect()}
    days = {s: (getattr(w, f"{s}_end") - getattr(w, f"{s}_start")).days + 1 for s in ("validation", "internal_test")}
    rows = [("unassigned_rows", found["unassigned"]["rows"])]
    rows += [(f"{s}_dates_missing", n - found[s].observed_dates) for s, n in days.items()]
    rows.append(("non_empty", int(not any(r["rows"] for r in found.values()))))
    return split_df.sparkSession.createDataFrame(rows, "rule string, violations long")


def model_start(df: DataFrame, required: Sequence[str] = tuple(S.SALES_LAG_COLUMNS + S.OIL_LAG_COLUMNS)) -> dt.date:
    """First date whose row has every required history column; raises if none."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"no warm-up without the columns {missing}")
    start = df.filter(all_not_null(required)).agg(F.min("date")).first()[0]
    if start is None:
        raise ContractError("No date has complete required sales and oil history.")
    return start


def split_labels(df: DataFrame, w: Windows, start: dt.date, date_col: str = "date") -> DataFrame:
    """Warm-up / Train / Validation / Internal test / Unassigned."""
    d = F.col(date_col)
    label = (
        F.when(d < F.lit(start), "Warm-up")
        .when(d.between(F.lit(start), F.lit(w.train_end)), "Train")
        .when(d.between(F.lit(w.validation_start), F.lit(w.validation_end)), "Validation")
        .when(d.between(F.lit(w.internal_test_start), F.lit(w.internal_test_end)), "Internal test")
        .otherwise("Unassigned")
    )
    return df.withColumn("split", label)


def missing_history(labeled: DataFrame, columns: Sequence[str], dp: int = 6) -> DataFrame:
    """% missing per split label and history column."""
    return labeled.groupBy("split").agg(*[
        F.round(F.lit(100.0) * count_if(F.col(c).isNull()).cast("double") / F.count(F.lit(1)).cast("double"), dp).alias(c)
        for c in columns
    ])


def pair_horizon(future: DataFrame) -> DataFrame:
    """Distinct forecast dates per (store, family) pair (two-level aggregation)."""
    return future.select("store_nbr", "family", "date").distinct().groupBy("store_nbr", "family").agg(
        F.count(F.lit(1)).alias("forecast_dates")
    )


def window_contract(periods: DataFrame, horizon_lag: int = min(S.SAFE_LAGS)) -> DataFrame:
    """Per period (start, end, cutoff): days, latest lag source, lag-safe flag.

    ``periods``: period, forecast_start, forecast_end, cutoff (dates).
    """
    return periods.select(
        "period", "forecast_start", "forecast_end", "cutoff",
        (F.datediff("forecast_end", "forecast_start") + 1).alias("days"),
        F.date_sub("forecast_end", horizon_lag).alias("latest_lag_source"),
        (F.date_sub("forecast_end", horizon_lag) <= F.col("cutoff")).alias("all_lags_available_by_cutoff"),
    )
