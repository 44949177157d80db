"""Table profiles and audits (A1-A6, A21, A22, A26): one aggregate pass per table."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if
from shelfcast.operators.contracts import duplicate_counts

RATE_DP = 6


def _null_cells(columns: Sequence[str]):
    return sum(F.count(F.when(F.col(c).isNull(), 1)) for c in columns)


def table_profile(df: DataFrame, name: str, key: Sequence[str] | None = None, date_col: str | None = "date") -> DataFrame:
    """A1: rows, columns, missing cells, duplicate-key member rows, date range (one row)."""
    aggs = [
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        _null_cells(df.columns).cast("long").alias("missing_cells"),
    ]
    if date_col:
        aggs += [F.min(date_col).cast("date").alias("date_min"), F.max(date_col).cast("date").alias("date_max")]
    else:
        aggs += [F.lit(None).cast("date").alias("date_min"), F.lit(None).cast("date").alias("date_max")]
    prof = df.agg(*aggs)
    if key:
        dup = duplicate_counts(df, key).select(F.col("member_rows").alias("duplicate_key_rows"))
        vals = dup.first()
        prof = prof.withColumn("duplicate_key_rows", F.lit(vals.duplicate_key_rows).cast("long"))
    else:
        prof = prof.withColumn("duplicate_key_rows", F.lit(0).cast("long"))
    return prof


def raw_conditions(sales: DataFrame, oil: DataFrame, holidays: DataFrame, gaps: DataFrame) -> DataFrame:
    """A2: zero / fractional / promoted counts and rates, missing oil prices, event classes, the calendar dates
    without a row (``gaps``: absent_date, at most the calendar's days) and non-unique holiday dates."""
    from shelfcast.operators.holidays import classify_events

    s = sales.agg(
        F.count(F.lit(1)).alias("sales_rows"),
        count_if(F.col("sales") == 0).alias("zero_sales_rows"),
        count_if(F.col("sales") % 1 != 0).alias("fractional_sales_rows"),
        count_if(F.col("onpromotion") > 0).alias("promoted_rows"),
    ).first()
    o = oil.agg(count_if(F.col("dcoilwtico").isNull()).alias("missing_oil_prices")).first()
    events = classify_events(holidays).agg(*[count_if(F.col(c)) for c in ("is_planned", "is_earthquake", "is_unknown_event")]).first()
    h = duplicate_counts(holidays, ["date"]).first()
    absent = sorted(r[0] for r in gaps.collect())

    def rate(n):
        return round(100.0 * n / s.sales_rows, RATE_DP) if s.sales_rows else None

    row = (
        s.sales_rows, s.zero_sales_rows, s.fractional_sales_rows, s.promoted_rows, rate(s.promoted_rows),
        o.missing_oil_prices, len(absent), h.member_rows, rate(s.zero_sales_rows),
        *(int(n or 0) for n in events), ", ".join(day.isoformat() for day in absent),
    )
    return sales.sparkSession.createDataFrame(
        [row],
        "sales_rows long, zero_sales_rows long, fractional_sales_rows long, promoted_rows long, "
        "promoted_rate_pct double, missing_oil_prices long, calendar_gap_dates long, nonunique_holiday_date_rows long, "
        "zero_sales_rate_pct double, planned_event_rows long, earthquake_event_rows long, unknown_event_rows long, "
        "calendar_gap_list string",
    )


def reconcile(raw: DataFrame, final: DataFrame, key: Sequence[str], allowed_null: Sequence[str]) -> DataFrame:
    """A3: structure before vs after: rows, columns, added columns, gap cells, unexpected cells, dup keys."""
    allowed = set(allowed_null)
    expected = [c for c in final.columns if c in allowed]
    other = [c for c in final.columns if c not in allowed]
    r = raw.agg(F.count(F.lit(1)).alias("raw_rows")).first()
    f = final.agg(
        F.count(F.lit(1)).alias("final_rows"),
        _null_cells(expected).cast("long").alias("expected_gap_cells"),
        _null_cells(other).cast("long").alias("unexpected_missing_cells"),
    ).first()
    d = duplicate_counts(final, key).first()
    spark = raw.sparkSession
    row = (
        r.raw_rows, f.final_rows, len(raw.columns), len(final.columns),
        len([c for c in final.columns if c not in raw.columns]),
        f.expected_gap_cells, f.unexpected_missing_cells, d.member_rows,
    )
    return spark.createDataFrame(
        [row],
        "raw_rows long, final_rows long, raw_columns long, final_columns long, added_columns long, "
        "expected_gap_cells long, unexpected_missing_cells long, duplicate_key_rows long",
    )


def column_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A4: per-column min / max / null count (one agg, then unpivot)."""
    aggs = []
    for c in columns:
        aggs += [
            F.min(c).cast("long").alias(f"{c}__min"),
            F.max(c).cast("long").alias(f"{c}__max"),
            F.count(F.when(F.col(c).isNull(), 1)).cast("long").alias(f"{c}__nulls"),
        ]
    wide = df.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                 F.col(f"{c}__nulls").alias("nulls"))
        for c in columns
    ])).alias("s")
    return wide.select(stacked).select("s.*")


def missing_audit(df: DataFrame) -> DataFrame:
    """Missing cells and rate per column, only columns that have nulls."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = wide.unpivot(["__rows"], cols, "column", "missing_cells")
    return long.filter(F.col("missing_cells") > 0).select(
        "column",
        F.col("missing_cells").cast("long").alias("missing_cells"),
        F.round(F.lit(100.0) * F.col("missing_cells") / F.col("__rows"), RATE_DP).alias("missing_rate_pct"),
    )


def structural_checks(df: DataFrame, nullable: Sequence[str], gap_count: int) -> DataFrame:
    """A5: (check, value) rows: gap cells, unexpected nulls, duplicates, negatives, distinct counts."""
    allowed = set(nullable)
    exp = [c for c in df.columns if c in allowed]
    oth = [c for c in df.columns if c not in allowed]
    wide = df.agg(
        _null_cells(exp).cast("long").alias("expected_history_gap_cells"),
        _null_cells(oth).cast("long").alias("unexpected_missing_cells"),
        count_if(F.col("sales") < 0).alias("negative_sales_rows"),
        F.size(F.collect_set("date")).cast("long").alias("unique_dates"),
        F.size(F.collect_set("store_nbr")).cast("long").alias("unique_stores"),
        F.size(F.collect_set("family")).cast("long").alias("unique_families"),
    )
    dup = duplicate_counts(df, S.BASE_KEY).first().extra_rows
    wide = wide.withColumns({
        "duplicate_date_store_family": F.lit(dup).cast("long"),
        "missing_calendar_dates": F.lit(gap_count).cast("long"),
    })
    names = [
        "expected_history_gap_cells", "unexpected_missing_cells", "duplicate_date_store_family",
        "negative_sales_rows", "unique_dates", "missing_calendar_dates", "unique_stores", "unique_families",
    ]
    return wide.unpivot([], names, "check", "value")


def oil_evidence(lookup: DataFrame, oil: DataFrame, lags: Sequence[int] = S.SAFE_LAGS) -> DataFrame:
    """Per lag: required dates, missing values, last-known (age > 0) values, max age; source range."""
    aggs = [F.count(F.lit(1)).alias("required_dates")]
    for lag in lags:
        v, a = f"oil_lag_{lag}", f"oil_lag_{lag}_age_days"
        aggs += [
            count_if(F.col(v).isNull()).alias(f"m{lag}"),
            count_if(F.col(a) > 0).alias(f"k{lag}"),
            F.max(a).cast("long").alias(f"x{lag}"),
        ]
    wide = lookup.agg(*aggs)
    src = oil.agg(F.min("date").alias("source_date_min"), F.max("date").alias("source_date_max")).first()
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(lag).alias("lag_days"), F.col("required_dates").alias("required_dates"),
            F.col(f"m{lag}").alias("missing_values"), F.col(f"k{lag}").alias("last_known_values"),
            F.col(f"x{lag}").alias("maximum_source_age_days"),
        )
        for lag in lags
    ])).alias("s")
    return wide.select(rows).select("s.*").withColumns({
        "source_date_min": F.lit(src.source_date_min).cast("date"),
        "source_date_max": F.lit(src.source_date_max).cast("date"),
    })


def transaction_evidence(lookup: DataFrame, lags: Sequence[int] = S.SAFE_LAGS) -> DataFrame:
    """Per lag: required store-dates, rows with no lag at all, missing values."""
    aggs = [
        F.count(F.lit(1)).alias("required_store_dates"),
        count_if(F.col("transactions_lag_available_count") == 0).alias("rows_with_no_available_lag"),
    ] + [count_if(F.col(f"transactions_lag_{lag}").isNull()).alias(f"m{lag}") for lag in lags]
    wide = lookup.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(lag).alias("lag_days"), F.col("required_store_dates").alias("required_store_dates"),
            F.col("rows_with_no_available_lag").alias("rows_with_no_available_lag"),
            F.col(f"m{lag}").alias("missing_values"),
        )
        for lag in lags
    ])).alias("s")
    return wide.select(rows).select("s.*")
