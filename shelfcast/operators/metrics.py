"""Forecast metrics (A13), segmented error summaries (A14), daily totals (A15),
forecast run summary (A24).

Sums of money-like measures are taken as DECIMAL so they are exact and
independent of summation order (the same on 8 or 8,000 tasks); ratios of
those exact sums are then plain IEEE divisions. Everything is one
``groupBy().agg`` with partial aggregation, so a hot segment collapses
map-side before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import clip_floor

MONEY = "decimal(28,8)"
RATIO_DP = 6


def _dsum(c: Column) -> Column:
    return F.sum(c.cast(MONEY)).cast("double")


def _sq_log_err(p: Column, a: Column) -> Column:
    return F.pow(F.log1p(p) - F.log1p(a), 2)


def forecast_metrics(
    df: DataFrame, actual: str = "sales", predicted: str = "predicted_sales", by: Sequence[str] = ()
) -> DataFrame:
    """One row, or one for each value of ``by``; predictions clipped at 0; a non-positive
    actual total raises at run time."""
    a = F.col(actual).cast("double")
    p = clip_floor(F.col(predicted).cast("double"), 0.0)
    agg = df.groupBy(*by).agg(
        _dsum(a).alias("_den"),
        F.avg(_sq_log_err(p, a)).alias("_msle"),
        _dsum(F.abs(p - a)).alias("_abs"),
        _dsum(p - a).alias("_sgn"),
        _dsum(F.greatest(a - p, F.lit(0.0))).alias("_under"),
        _dsum(F.greatest(p - a, F.lit(0.0))).alias("_over"),
    )
    den = F.col("_den")
    guard = F.when(den.isNull() | (den <= 0), F.raise_error(F.lit("Aggregate actual sales must be positive.")))

    def pct(c: str) -> Column:
        return F.coalesce(guard, F.round(F.col(c) / den * 100.0, RATIO_DP).cast("double"))

    return agg.select(
        *by,
        F.round(F.sqrt("_msle"), RATIO_DP).alias("rmsle"),
        pct("_abs").alias("wape_pct"),
        pct("_sgn").alias("signed_bias_pct"),
        pct("_under").alias("underforecast_pct"),
        pct("_over").alias("overforecast_pct"),
    )


def error_summary(
    df: DataFrame,
    by: Sequence[str],
    actual: str = "sales",
    predicted: str = "predicted_sales",
    total_abs_error: float | None = None,
) -> DataFrame:
    """Rows, sums, rmsle, wape, bias (zero actual -> NULL), share of the GLOBAL absolute error.

    ``total_abs_error`` is the global frame's absolute error; when omitted it
    is computed from ``df`` with one scalar aggregate.
    """
    a = F.col(actual).cast("double")
    p = F.col(predicted).cast("double")
    if total_abs_error is None:
        total_abs_error = df.agg(_dsum(F.abs(p - a))).first()[0]
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        _dsum(a).alias("actual_sales"),
        _dsum(p).alias("predicted_sales"),
        _dsum(F.abs(p - a)).alias("absolute_error"),
        _dsum(p - a).alias("_signed"),
        F.avg(_sq_log_err(p, a)).alias("_msle"),
    )
    den = F.nullif(F.col("actual_sales"), F.lit(0.0))
    tot = F.nullif(F.lit(total_abs_error).cast("double"), F.lit(0.0))
    return g.select(
        *by,
        "rows",
        "actual_sales",
        "predicted_sales",
        "absolute_error",
        F.round(F.sqrt("_msle"), RATIO_DP).alias("rmsle"),
        F.round(F.col("absolute_error") / den * 100.0, RATIO_DP).alias("wape_pct"),
        F.round(F.col("_signed") / den * 100.0, RATIO_DP).alias("signed_bias_pct"),
        F.round(F.col("absolute_error") / tot * 100.0, RATIO_DP).alias("error_contribution_pct"),
    )


def daily_totals(df: DataFrame, actual: str = "sales", predicted: str = "predicted_sales") -> DataFrame:
    """Actual vs predicted totals per date."""
    return df.groupBy("date").agg(
        _dsum(F.col(actual)).alias("actual_sales"),
        _dsum(F.col(predicted)).alias("predicted_sales"),
    )


def forecast_summary(forecast: DataFrame, value: str = "forecast_sales") -> DataFrame:
    """Rows, first and last date, min / mean / max prediction."""
    v = F.col(value).cast("double")
    return forecast.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.round(F.min(v), RATIO_DP).alias("min_forecast"),
        F.round(F.sum(v.cast(MONEY)).cast("double") / F.count(F.lit(1)).cast("double"), RATIO_DP).alias("mean_forecast"),
        F.round(F.max(v), RATIO_DP).alias("max_forecast"),
    )


def forecast_day(df: DataFrame, date_col: str = "date") -> DataFrame:
    """1-based day index from the frame's first date (one scalar aggregate)."""
    first = df.agg(F.min(date_col)).first()[0]
    return df.withColumn("forecast_day", (F.datediff(date_col, F.lit(first).cast("date")) + 1).cast("int"))


def segments(df: DataFrame) -> DataFrame:
    """Promotion / holiday / weekend segment labels."""
    return df.withColumns({
        "promotion_segment": F.when(F.col("onpromotion") > 0, "Promotion").otherwise("No promotion"),
        "holiday_segment": F.when(F.col("is_holiday") == 1, "Holiday").otherwise("Non-holiday"),
        "is_weekend_group": F.col("day_of_week").isin(6, 7),
    })
