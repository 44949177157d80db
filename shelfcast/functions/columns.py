"""Scalar column expressions used across operators."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week_iso(date_col: str | Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return (F.weekday(col(date_col)) + 1).cast("int")


def is_finite(c: str | Column) -> Column:
    """True for non-null values that are neither NaN nor +-infinity."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip_floor(c: str | Column, floor: float = 0.0) -> Column:
    """``max(x, floor)`` that keeps NULL and NaN visible (greatest() hides NULL)."""
    x = col(c)
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), x).otherwise(
        F.greatest(x, F.lit(float(floor)))
    )


def nonnull_count(columns: Iterable[str]) -> Column:
    """Row-wise number of non-null values among ``columns``."""
    terms = [F.col(c).isNotNull().cast("int") for c in columns]
    return reduce(lambda a, b: a + b, terms).cast("int")


def all_not_null(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is true (NULL counts as false)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with a zero denominator giving NULL (ANSI-safe)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def pct(num: Column, den: Column) -> Column:
    return F.lit(100.0) * num / F.nullif(den.cast("double"), F.lit(0.0))


def decimal_sum(c: str | Column, scale: int = 4) -> Column:
    """Exact, order-independent sum of a double measure held at ``scale`` decimals."""
    return F.sum(col(c).cast(f"decimal(18,{scale})")).cast("double")
