"""Training-period exploration (A8-A11, A16, A20), rolling mean (W1), top-k (L2), best-per-group.

All group summaries are ``groupBy().agg`` with partial aggregation; money
sums are DECIMAL (exact, order-free); the exact median is the
skew-safe distributed one of ``quantiles`` (interpolated, like pandas). Top-k uses ``orderBy().limit`` which
plans as TakeOrderedAndProject (per-task top-k, then merge): no global sort.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.columns import count_if
from shelfcast.operators.quantiles import grouped_median

MONEY = "decimal(28,8)"
DP = 6
STAT_DP = 4


def _total(c: str = "sales") -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast("double")


def _mean(c: str = "sales") -> Column:
    return F.sum(F.col(c).cast(MONEY)).cast("double") / F.count(F.lit(1)).cast("double")


def _zero_rate(c: str = "sales") -> Column:
    return F.round(F.lit(100.0) * count_if(F.col(c) == 0).cast("double") / F.count(F.lit(1)).cast("double"), DP)


def train_summary(train: DataFrame) -> DataFrame:
    """A8."""
    return train.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        # Sets of the dimensions' values: no row is expanded for a distinct count.
        F.size(F.collect_set("date")).cast("long").alias("observed_dates"),
        F.size(F.collect_set("store_nbr")).cast("long").alias("stores"),
        F.size(F.collect_set("family")).cast("long").alias("product_families"),
        _zero_rate().alias("zero_sales_rate_pct"),
        F.round(F.lit(100.0) * count_if(F.col("onpromotion") > 0).cast("double") / F.count(F.lit(1)).cast("double"), DP).alias(
            "promotion_rows_pct"
        ),
    )


def family_summary(train: DataFrame) -> DataFrame:
    """Total, mean per row, zero-rate % per family."""
    return train.groupBy("family").agg(
        _total().alias("total_sales"),
        F.round(_mean(), DP).alias("average_daily_store_sales"),
        _zero_rate().alias("zero_sales_rate_pct"),
    )


def store_summary(train: DataFrame) -> DataFrame:
    """A10."""
    return train.groupBy("store_nbr").agg(
        _total().alias("total_sales"), F.round(_mean(), DP).alias("average_daily_family_sales")
    )


def promotion_summary(train: DataFrame) -> DataFrame:
    """Rows, mean, exact median, zero rate; labelled with / without promotion."""
    label = F.when(F.col("onpromotion") > 0, "with promotion").otherwise("without promotion")
    lab = train.withColumn("has_promotion", label)
    base = lab.groupBy("has_promotion").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(_mean(), DP).alias("mean_sales"),
        _zero_rate().alias("zero_sales_rate_pct"),
    )
    med = grouped_median(lab, ["has_promotion"], "sales", "median_sales")
    return base.join(med, "has_promotion", "left").select(
        "has_promotion", "rows", "mean_sales", F.round("median_sales", STAT_DP).alias("median_sales"), "zero_sales_rate_pct"
    )


def describe_where(df: DataFrame, groups: dict[str, Column], value: str = "sales") -> DataFrame:
    """Count, mean, median, std (ddof=1) of ``value`` per named predicate, side by side.

    One pass: each group is a labelled row (a row can fall in several groups,
    so they are exploded, not unioned scans).
    """
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]))
    exploded = df.select(F.explode(labels).alias("group"), F.col(value).alias("v"))
    base = exploded.groupBy("group").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.sum(F.col("v").cast(MONEY)).cast("double") / F.count(F.lit(1)).cast("double"), STAT_DP).alias("mean"),
        F.round(F.stddev_samp("v"), STAT_DP).alias("std"),
    )
    med = grouped_median(exploded, ["group"], "v")
    return base.join(med, "group", "left").select(
        "group", "count", "mean", F.round("median", STAT_DP).alias("median"), "std"
    )


def calendar_groups() -> dict[str, Column]:
    weekend = F.col("day_of_week").isin(6, 7)
    hol = F.col("is_holiday") == 1
    return {
        "weekday_non_holiday": ~weekend & ~hol,
        "weekend_non_holiday": weekend & ~hol,
        "holiday": hol,
    }


def findings(train: DataFrame) -> DataFrame:
    """Zero rate, top family, top store, promoted / non-promoted mean ratio (one row)."""
    fam = family_summary(train).orderBy(F.desc("total_sales"), "family").limit(1).first()
    sto = store_summary(train).orderBy(F.desc("total_sales"), "store_nbr").limit(1).first()
    agg = train.agg(
        _zero_rate().alias("zero_sales_rate_pct"),
        (F.sum(F.when(F.col("onpromotion") > 0, F.col("sales").cast(MONEY))).cast("double")
         / count_if(F.col("onpromotion") > 0).cast("double")).alias("_mp"),
        (F.sum(F.when(F.col("onpromotion") <= 0, F.col("sales").cast(MONEY))).cast("double")
         / count_if(F.col("onpromotion") <= 0).cast("double")).alias("_mn"),
    )
    return agg.select(
        "zero_sales_rate_pct",
        F.lit(fam.family if fam else None).alias("top_family"),
        F.lit(sto.store_nbr if sto else None).cast("int").alias("top_store"),
        F.round(F.col("_mp") / F.nullif(F.col("_mn"), F.lit(0.0)), DP).alias("promotion_mean_ratio"),
    )


def daily_sales(train: DataFrame) -> DataFrame:
    return train.groupBy("date").agg(_total().alias("daily_sales"))


def rolling_mean(daily: DataFrame, value: str = "daily_sales", days: int = 28, min_periods: int = 7,
                 by: Sequence[str] = ()) -> DataFrame:
    """Calendar-day trailing mean (not row-based), NULL below ``min_periods`` observations.

    ``daily`` has one row for each day and key, so a key's frame is bounded by the calendar, whatever the
    facts behind it; a range frame over day numbers leaves days out that have no row.
    """
    day = F.unix_date("date")
    frame = Window.partitionBy(*by).orderBy(day).rangeBetween(-(days - 1), 0)
    n, total = F.count(F.lit(1)).over(frame), F.sum(F.col(value).cast(MONEY)).over(frame).cast("double")
    return daily.select(
        *by, "date", value, F.when(n >= min_periods, total / n.cast("double")).alias(f"rolling_{days}d_mean")
    )


def top_k(df: DataFrame, by: str, k: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    """L2: top ``k`` rows by ``by`` descending, deterministic tie-break."""
    return df.orderBy(F.desc(by), *tie).limit(k)


def best_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per group under ascending ``order`` (then the remaining columns).

    ``min(struct(order..., rest...))`` per group: a partial aggregate, so a
    hot group is reduced map-side instead of being sorted in one window task.
    """
    rest = [c for c in df.columns if c not in set(group) | set(order)]
    best = df.groupBy(*group).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in list(order) + rest]).select(*df.columns)
