"""Raw tables -> leak-safe feature tables (M13) and model-time sales lags.

Physical shape at scale: the base fact table is scanned once; every lookup
(oil as-of by date, transaction lags by (date, store), holiday flags by
date / state / city, store metadata) is keyed by at most date x store and
is written once, so the planner knows its bytes and broadcasts it under its own
limit; then the base is not shuffled for them.
The only base-sized shuffle is the sales-lag join, which moves history x 4
narrow rows plus the base once on the full (date, store, family) key, so a
hot store or family still spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import holidays as H
from shelfcast.operators.contracts import ContractError, audit, duplicate_counts, enforce, enforce_all
from shelfcast.operators.joins import add_calendar_features, store_contract, store_join, stored_base_contract
from shelfcast.operators.lags import asof_lookup, exact_lag_lookup, exact_lags
from shelfcast.functions.columns import count_if, nonnull_count
from shelfcast.session import drop_written, new_output_path, written_lookup
from shelfcast.sources import readers as R


@dataclass
class RawTables:
    train: DataFrame
    test: DataFrame
    stores: DataFrame  # already renamed: store_type, store_cluster
    oil: DataFrame
    transactions: DataFrame
    holidays: DataFrame


def oil_lookup(dates: DataFrame, oil: DataFrame) -> DataFrame:
    """J3 for the oil series: value and age per safe lag, keyed by date."""
    return asof_lookup(dates, oil, S.SAFE_LAGS, "oil", "dcoilwtico")


def transaction_lookup(transactions: DataFrame) -> DataFrame:
    """Exact (date - lag, store) transaction counts, keyed by (date, store_nbr)."""
    return exact_lag_lookup(transactions, ["store_nbr"], "transactions", S.SAFE_LAGS, "transactions")


def attach_features(
    base: DataFrame,
    stores: DataFrame,
    oil_lk: DataFrame,
    txn_lk: DataFrame,
    holidays: DataFrame | dict,
    has_target: bool,
    validate: bool = True,
    name: str = "base",
) -> DataFrame:
    df = store_join(base, stores, name=name, validate=validate, stores_checked=validate)
    df = add_calendar_features(df)
    df = df.join(oil_lk, "date", "left")
    df = df.join(txn_lk, ["date", "store_nbr"], "left").withColumn(
        "transactions_lag_available_count", nonnull_count(S.TRANSACTION_LAG_COLUMNS)
    )
    df = H.attach_holiday_flags(df, holidays, check=validate)
    cols = S.LABELED_COLUMNS if has_target else S.FUTURE_COLUMNS
    return df.select(*cols)


def check_raw(raw: RawTables) -> dict[str, int]:
    """All source and base contracts by one action; the rows of each table."""
    try:
        return enforce_all({
            **R.source_contracts(raw.oil, raw.transactions, raw.holidays),
            "stores": store_contract(raw.stores),
            "train": stored_base_contract(raw.train, raw.stores),
            "test": stored_base_contract(raw.test, raw.stores),
        })
    except R.ContractError as error:
        if "unknown_event" in str(error):
            H.raise_on_unknown_events(H.classify_events(raw.holidays))  # lists the descriptions
        raise


def build_feature_tables(raw: RawTables, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labeled 34 columns, future 33 columns)."""
    if validate:
        check_raw(raw)
    dates = raw.train.select("date").unionByName(raw.test.select("date")).distinct()
    # Lookups are keyed by date or (date, store): written once for both base tables.
    oil_lk = written_lookup(oil_lookup(dates, raw.oil), "oil")
    txn_lk = written_lookup(transaction_lookup(raw.transactions), "transactions")
    hol_lk = H.prepared_lookups(raw.holidays, check=False)  # unknown events already audited
    labeled = attach_features(raw.train, raw.stores, oil_lk, txn_lk, hol_lk, True, False, "train")
    future = attach_features(raw.test, raw.stores, oil_lk, txn_lk, hol_lk, False, False, "test")
    return labeled, future


def publish_feature_tables(raw: RawTables) -> tuple[DataFrame, DataFrame]:
    """M13 written: both tables by one job, so they share the lookups' broadcasts, and read back.

    While the rows are written, the part of V3 that one row can break is measured: if a table has a missing
    value outside the allowlist, or not the rows of its base, nothing is published and the files are removed.
    """
    expected = check_raw(raw)
    labeled, future = build_feature_tables(raw, validate=False)
    allowed = set(S.ALLOWED_MISSING_COLUMNS)
    watched, parts = {}, []
    for name, table in (("train", labeled), ("test", future)):
        watched[name] = watch = Observation()
        missing = F.greatest(*[F.col(c).isNull() for c in table.columns if c not in allowed])
        parts.append(table.observe(watch, F.count(F.lit(1)).alias("rows"), count_if(missing).alias("unexpected"))
                     .withColumn("table", F.lit(name)))
    path = new_output_path(labeled.sparkSession, "features")
    parts[0].unionByName(parts[1], allowMissingColumns=True).write.partitionBy("table").parquet(path)
    for name, watch in watched.items():
        seen = watch.get
        if seen["unexpected"] or seen["rows"] != expected[name]:
            drop_written(labeled.sparkSession, path)
            raise ContractError(
                f"{name}: {seen['unexpected']} rows lack a required value; {seen['rows']} rows for {expected[name]}"
            )
    spark = labeled.sparkSession
    return tuple(spark.read.schema(t.schema).parquet(f"{path}/table={n}") for n, t in (("train", labeled), ("test", future)))


def final_counts(processed: DataFrame, original: DataFrame, has_target: bool = True) -> DataFrame:
    """V3 as the eight counters of one row. Rows have no order here: ids are preserved if the tables hold the
    same ones, each once; the target if it is equal id by id."""
    allowed = set(S.ALLOWED_MISSING_COLUMNS)

    def cells(columns):
        return F.coalesce(sum((F.sum(F.col(c).isNull().cast("long")) for c in columns), F.lit(0)), F.lit(0)).cast("long")

    shape = processed.agg(
        F.count(F.lit(1)).alias("output_rows"),
        cells([c for c in processed.columns if c in allowed]).alias("expected_missing_feature_cells"),
        cells([c for c in processed.columns if c not in allowed]).alias("unexpected_missing_cells"),
    )
    target = "sales" if has_target else "id"
    before = original.select("id", F.col(target).alias("_before"), F.lit(1).alias("_o"))
    after = processed.select("id", F.col(target).alias("_after"), F.lit(1).alias("_p"))
    before, after = (t.groupBy("id").agg(F.count(F.lit(1)).alias(n), F.max(v).alias(v)) for t, n, v in ((before, "_o", "_before"), (after, "_p", "_after")))
    pairs = before.withColumnRenamed("id", "_id").join(after, F.col("_id").eqNullSafe(F.col("id")), "full").agg(
        F.coalesce(F.sum("_o"), F.lit(0)).cast("long").alias("input_rows"),
        (F.count_if(~F.coalesce(F.col("_o") == F.col("_p"), F.lit(False))) == 0).alias("ids_preserved"),
        (F.count_if(~F.col("_before").eqNullSafe(F.col("_after"))) == 0).alias("target_preserved"),
    )
    repeated = duplicate_counts(processed, S.BASE_KEY).select(F.col("member_rows").alias("duplicate_base_key_rows"))
    rows = [t.first() for t in (shape, pairs, repeated)]
    facts = {k: v for row in rows for k, v in row.asDict().items()}
    facts |= {"output_columns": len(processed.columns), "target_preserved": bool(facts["target_preserved"]) and has_target}
    schema = ("input_rows long, output_rows long, output_columns long, expected_missing_feature_cells long, "
              "unexpected_missing_cells long, duplicate_base_key_rows long, ids_preserved boolean, target_preserved boolean")
    names = [f.split()[0] for f in schema.split(", ")]
    return processed.sparkSession.createDataFrame([tuple(facts[n] for n in names)], schema)


def final_rules(processed: DataFrame, original: DataFrame | None = None, has_target: bool = True) -> DataFrame:
    """V3: unique key, nulls only in the allowlist, rows and target preserved.

    Rows/target are compared by a full outer join on ``id`` (row order has no
    meaning in Spark), so a changed, lost or added row is a violation.
    """
    allowed = set(S.ALLOWED_MISSING_COLUMNS) | set(S.SALES_NULLABLE_COLUMNS)
    checked = [c for c in processed.columns if c not in allowed]
    rules = {"unexpected_missing_cells": F.greatest(*[F.col(c).isNull() for c in checked])}
    result = audit(processed, rules, unique={"duplicate_base_key": S.BASE_KEY})
    if original is not None:
        o = original.select("id", *(["sales"] if has_target else []), F.lit(1).alias("_o"))
        p = processed.select("id", *([F.col("sales").alias("_ps")] if has_target else []), F.lit(1).alias("_p"))
        j = o.join(p, "id", "full")
        rr = {"lost_rows": F.col("_p").isNull(), "added_rows": F.col("_o").isNull()}
        if has_target:
            rr["target_changed"] = F.col("_o").isNotNull() & F.col("_p").isNotNull() & ~F.col("sales").eqNullSafe(F.col("_ps"))
        result = result.unionByName(audit(j, rr))
    return result


def add_sales_lags(target: DataFrame, history: DataFrame, check_unique: bool = True) -> DataFrame:
    """Exact sales lags by (date - lag, store, family) + available count."""
    hist = history.select(*S.BASE_KEY, "sales")
    return exact_lags(
        target, hist, ["store_nbr", "family"], "sales", S.SAFE_LAGS, "sales",
        count_col="sales_lag_available_count", check_unique=check_unique,
    )


def enforce_final(processed: DataFrame, original: DataFrame, has_target: bool, name: str) -> DataFrame:
    return enforce(final_rules(processed, original, has_target), name, error=RuntimeError)
