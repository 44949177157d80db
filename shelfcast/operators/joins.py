"""Guarded joins: base population is preserved, support sides are proved unique.

A left join whose right side is unique on the join keys can neither drop nor
duplicate left rows, so proving uniqueness of the (usually small) support
side replaces the row-by-row "ids unchanged" comparison of an in-memory
pipeline. Required added columns are checked with one ``count_if`` pass.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if, day_of_week_iso
from shelfcast.operators.contracts import Contract, ContractError, audit, duplicate_counts, enforce


def add_calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """P10: month, day_of_month, day_of_week (Mon=1..Sun=7)."""
    return df.withColumns({
        "month": F.month(date_col).cast("int"),
        "day_of_month": F.dayofmonth(date_col).cast("int"),
        "day_of_week": day_of_week_iso(date_col),
    })


def base_contract(base: DataFrame, key: Sequence[str] = tuple(S.BASE_KEY)) -> Contract:
    """V1: non-empty, no null key, unique key, id present and unique, valid date."""
    return Contract(
        base,
        row_rules={
            "null_base_key": F.greatest(*[F.col(k).isNull() for k in key]),
            "null_id": F.col("id").isNull(),
            "invalid_date": F.col("date").isNull(),
        },
        unique={"duplicate_base_key": list(key), "duplicate_id": ["id"]},
        non_empty=True,
    )


def base_rules(base: DataFrame, key: Sequence[str] = tuple(S.BASE_KEY)) -> DataFrame:
    """V1 as an audit."""
    return base_contract(base, key).audit()


def stored_base_contract(base: DataFrame, stores: DataFrame) -> Contract:
    """V1 and "every store exists" of a base table. A store that is listed twice counts once."""
    known = stores.select("store_nbr", F.lit(True).alias("_known")).distinct()
    contract = base_contract(base.join(known, "store_nbr", "left"))
    return contract._replace(row_rules={**contract.row_rules, "store_absent_from_stores": F.col("_known").isNull()})


def stored_base_rules(base: DataFrame, stores: DataFrame) -> DataFrame:
    """The audit of ``stored_base_contract``."""
    return stored_base_contract(base, stores).audit()


def store_contract(stores: DataFrame) -> Contract:
    """V2: non-empty, key present and unique, metadata complete."""
    return Contract(
        stores,
        row_rules={
            "null_store_nbr": F.col("store_nbr").isNull(),
            "missing_store_metadata": F.greatest(*[F.col(c).isNull() for c in S.STORE_OUTPUT_COLUMNS]),
        },
        unique={"duplicate_store_nbr": ["store_nbr"]},
        non_empty=True,
    )


def store_rules(stores: DataFrame) -> DataFrame:
    """V2 as an audit."""
    return store_contract(stores).audit()


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys are absent from ``right`` (anti-join)."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def attach_m1(
    base: DataFrame,
    support: DataFrame,
    keys: Sequence[str],
    added: Sequence[str],
    nullable: Sequence[str] = (),
    name: str = "attach",
    check_required: bool = False,
) -> DataFrame:
    """Many-to-one left join with proved support uniqueness.

    ``check_required`` runs the null check on required added columns now;
    pipelines usually defer it to one final table audit (V3).
    """
    sup = support.select(*keys, *added)
    extra = duplicate_counts(sup, keys).first().extra_rows
    if extra:
        raise ContractError(f"{name} support table is not unique on {list(keys)}.")
    joined = base.join(sup, list(keys), "left")
    if check_required:
        required = [c for c in added if c not in set(nullable)]
        if required:
            enforce(audit(joined, {f"null_{c}": F.col(c).isNull() for c in required}), name)
    return joined


def store_join(
    base: DataFrame, stores: DataFrame, name: str = "base", validate: bool = True, stores_checked: bool = False
) -> DataFrame:
    """Attach store metadata (m:1); every store must exist.

    With ``validate`` the base contract (V1) and the "store exists" rule run as ONE action; the
    store contract (V2) runs unless the caller already checked it.
    """
    st = stores.select("store_nbr", *S.STORE_OUTPUT_COLUMNS)
    if validate:
        if not stores_checked:
            enforce(store_rules(stores), "stores")
        enforce(stored_base_rules(base, stores), name)
    return base.join(st, "store_nbr", "left").select(*base.columns, *S.STORE_OUTPUT_COLUMNS)


def store_join_evidence(base: DataFrame, joined: DataFrame) -> DataFrame:
    """in/out rows, unique ids, duplicate-key member rows, null metadata cells, date range."""
    ins = base.agg(
        F.count(F.lit(1)).alias("input_rows"), F.countDistinct("id").alias("input_unique_ids")
    )
    outs = joined.agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.countDistinct("id").alias("output_unique_ids"),
        sum(F.count(F.when(F.col(c).isNull(), 1)) for c in S.STORE_OUTPUT_COLUMNS).cast("long").alias(
            "missing_store_metadata_cells_after_join"
        ),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("date_max"),
    )
    dup = duplicate_counts(joined, S.BASE_KEY).select(F.col("member_rows").alias("base_key_duplicate_rows_after_join"))
    a, b, c = ins.first(), outs.first(), dup.first()
    row = {**a.asDict(), **b.asDict(), **c.asDict()}
    order = [
        "input_rows", "output_rows", "input_unique_ids", "output_unique_ids",
        "base_key_duplicate_rows_after_join", "missing_store_metadata_cells_after_join", "date_min", "date_max",
    ]
    schema = ", ".join(f"{k} {'string' if k.startswith('date') else 'long'}" for k in order)
    return base.sparkSession.createDataFrame([tuple(row[k] for k in order)], schema)


def pair_coverage(future: DataFrame, history: DataFrame, keys: Sequence[str] = tuple(S.PAIR_KEY)) -> DataFrame:
    """One row (missing_pairs, unexpected_pairs) after type normalisation."""
    same = all(future.schema[k].dataType == history.schema[k].dataType for k in keys)

    def pairs(df: DataFrame) -> DataFrame:
        if same:  # as they are: a table laid out by these keys needs no exchange
            return df.select(*keys).distinct()
        return df.select(F.col("store_nbr").cast("long").alias("store_nbr"), F.col("family").cast("string").alias("family")).distinct()

    h = pairs(history).withColumn("_h", F.lit(1))
    f = pairs(future).withColumn("_f", F.lit(1))
    both = h.join(f, list(keys), "full")
    return both.agg(
        count_if(F.col("_f").isNull()).alias("missing_pairs"),
        count_if(F.col("_h").isNull()).alias("unexpected_pairs"),
    )


def require_pair_coverage(future: DataFrame, history: DataFrame) -> None:
    row = pair_coverage(future, history).first()
    if row.missing_pairs or row.unexpected_pairs:
        raise ContractError(
            "Future store-family coverage differs from history: "
            f"{row.missing_pairs} missing and {row.unexpected_pairs} unexpected pairs."
        )


def calendar_gaps(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar dates between min and max that have no row (one column ``absent_date``)."""
    bounds = df.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias(date_col))
    seen = df.select(date_col).distinct()
    return days.join(seen, date_col, "left_anti").select(F.col(date_col).alias("absent_date"))


def forecast_parity(
    actual: DataFrame,
    expected: DataFrame,
    key: Sequence[str] = ("id", "date", "store_nbr", "family"),
    value: str = "forecast_sales",
    rtol: float = 1e-6,
    atol: float = 1e-6,
) -> DataFrame:
    """Identity rows and values within ``atol + rtol*|expected|``; one summary row."""
    a = actual.select(*key, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    e = expected.select(*key, F.col(value).alias("_e"), F.lit(1).alias("_in_e"))
    j = a.join(e, list(key), "full")
    close = F.abs(F.col("_a") - F.col("_e")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("_e"))
    return j.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        count_if(F.col("_in_e").isNull()).alias("unexpected_rows"),
        count_if(F.col("_in_a").isNull()).alias("missing_rows"),
        count_if(F.col("_in_a").isNotNull() & F.col("_in_e").isNotNull() & ~close).alias("value_mismatches"),
        count_if(F.col("_in_a").isNotNull() & F.col("_in_e").isNotNull() & close).alias("matching_rows"),
        F.countDistinct(F.when(F.col("_in_a").isNotNull(), F.col("date"))).alias("forecast_dates"),
    )


def submission(template: DataFrame, forecast: DataFrame) -> DataFrame:
    """Template ids with forecasts (join on id, every template id must match once)."""
    fc = forecast.select("id", F.col("forecast_sales").cast("double").alias("sales"))
    out = template.select("id").join(fc, "id", "left")
    bad = out.agg(count_if(F.col("sales").isNull()).alias("n")).first().n
    if bad:
        raise ContractError(f"submission: {bad} template ids have no forecast.")
    return out
