"""Typed scans with contract checks (S1-S9, S11) and sinks.

CSV is read with an explicit schema, ``enforceSchema=False`` (the header
must match the schema's names and order) and ``FAILFAST`` (a malformed or
overflowing value raises); the schema is never inferred. Parquet is the
primary storage format: filters and column pruning reach the scan.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas as S
from shelfcast.functions.columns import is_finite
from shelfcast.operators.contracts import Contract, ContractError, audit, enforce, require_columns
from shelfcast.session import path_exists
from shelfcast.sources.publish import footer_bounds, publish, stage


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    expected_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Typed read; CSV header must equal the schema (names and order)."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV reads need an explicit schema")
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("mode", "FAILFAST")
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path)
        )
    elif fmt == "parquet":
        df = spark.read.parquet(path)
        if schema is not None:
            require_columns(df, schema.names, path)
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    else:
        df = spark.read.format(fmt).load(path) if schema is None else spark.read.schema(schema).format(fmt).load(path)
    if expected_columns is not None:
        require_columns(df, expected_columns, path)
    return df


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header-only probe (a one-line job; no schema so the file decides)."""
    return spark.read.option("header", True).csv(path).columns


#: Column of the text of a line that its schema cannot hold.
REJECTED_LINE = "rejected_line"


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines with reason) of a CSV table; nothing is dropped silently.

    The header must be the schema's columns in order, or the whole table is refused. A line is rejected if it
    has too few or too many fields (``field_count``) or a value that its column's type cannot hold
    (``bad_value``); empty fields are nulls.
    """
    header = csv_header(spark, path)
    if header != schema.names:
        raise ContractError(f"{path}: header {header} is not {schema.names}")
    wide = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField(REJECTED_LINE, T.StringType())])
    options = {"mode": "PERMISSIVE", "dateFormat": "yyyy-MM-dd", "columnNameOfCorruptRecord": REJECTED_LINE}
    # Lines are parsed here and not by the scan, which could not be asked for the rejected ones alone.
    lines = spark.read.text(path).where((F.col("value") != ",".join(header)) & (F.length(F.trim("value")) > 0))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.fields)
    rows = lines.select(F.from_csv("value", ddl, options).alias("p")).select("p.*")
    good = rows.where(F.col(REJECTED_LINE).isNull()).select(*schema.names)
    # A quoted field may hold separators: those inside quotes are no field ends.
    plain = F.regexp_replace(REJECTED_LINE, r'"[^"]*"', "")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","))) + 1
    reason = F.when(fields != len(schema.names), "field_count").otherwise("bad_value")
    return good, rows.where(F.col(REJECTED_LINE).isNotNull()).select(REJECTED_LINE, reason.alias("reason"))


def source_contracts(oil: DataFrame, transactions: DataFrame, holidays: DataFrame) -> dict[str, Contract]:
    """S3 + S4 + S5 + H2: the contracts of the three small sources."""
    from shelfcast.operators.holidays import classify_events

    require_columns(oil, S.OIL_COLUMNS, "oil")
    require_columns(transactions, S.TRANSACTION_COLUMNS, "transactions")
    require_columns(holidays, S.HOLIDAY_COLUMNS, "holidays")
    v = F.col("dcoilwtico")
    return {
        "oil": Contract(oil, {
            "null_date": F.col("date").isNull(),
            "bad_price": v.isNotNull() & (~is_finite(v) | (v <= 0)),
        }, {"duplicate_date": ["date"]}),
        "transactions": Contract(transactions, {
            "null_value": F.greatest(*[F.col(c).isNull() for c in S.TRANSACTION_COLUMNS]),
            "negative": F.col("transactions") < 0,
        }, {"duplicate_date_store": ["date", "store_nbr"]}),
        "holidays": Contract(classify_events(holidays), {
            "null_value": F.greatest(*[F.col(x).isNull() for x in S.HOLIDAY_COLUMNS]),
            "unknown_event": F.col("is_unknown_event"),
        }),
    }


def check_oil(oil: DataFrame) -> DataFrame:
    """S3: dates valid and unique; available prices finite and positive."""
    require_columns(oil, S.OIL_COLUMNS, "oil")
    v = F.col("dcoilwtico")
    return enforce(audit(
        oil,
        {"null_date": F.col("date").isNull(), "bad_price": v.isNotNull() & (~is_finite(v) | (v <= 0))},
        unique={"duplicate_date": ["date"]},
    ), "oil")


def check_transactions(tx: DataFrame) -> DataFrame:
    """No nulls, unique (date, store), non-negative counts."""
    require_columns(tx, S.TRANSACTION_COLUMNS, "transactions")
    return enforce(audit(
        tx,
        {
            "null_value": F.greatest(*[F.col(c).isNull() for c in S.TRANSACTION_COLUMNS]),
            "negative_transactions": F.col("transactions") < 0,
        },
        unique={"duplicate_date_store": ["date", "store_nbr"]},
    ), "transactions")


def check_holidays(h: DataFrame) -> DataFrame:
    """No missing values."""
    require_columns(h, S.HOLIDAY_COLUMNS, "holidays")
    return enforce(audit(h, {"null_value": F.greatest(*[F.col(c).isNull() for c in S.HOLIDAY_COLUMNS])}), "holidays")


def processed_contract(df: DataFrame, has_target: bool) -> Contract:
    """Exact header, non-empty, key and id present + unique, target valid / absent."""
    expected = S.LABELED_COLUMNS if has_target else S.FUTURE_COLUMNS
    require_columns(df, expected, "processed table")
    rules = {
        "null_base_key": F.greatest(*[F.col(k).isNull() for k in S.BASE_KEY]),
        "null_id": F.col("id").isNull(),
    }
    if has_target:
        rules["invalid_sales"] = F.col("sales").isNull() | (F.col("sales") < 0)
    return Contract(df, rules, {"duplicate_base_key": S.BASE_KEY, "duplicate_id": ["id"]}, True)


def processed_rules(df: DataFrame, has_target: bool) -> DataFrame:
    """S6 as an audit."""
    return processed_contract(df, has_target).audit()


def history_window(df: DataFrame, end: dt.date, days: int = S.HISTORY_DAYS, check_end: bool = True) -> DataFrame:
    """The four history columns of ``[end - days + 1, end]``.

    The max date over ALL rows must equal ``end`` (one aggregate over the
    date column only); later rows therefore fail it too.
    """
    start = end - dt.timedelta(days=days - 1)
    if check_end:
        observed = df.agg(F.max("date")).first()[0]
        if observed != end:
            raise ContractError(f"History end date {observed} differs from the training cutoff {end}.")
    return df.select(*S.INFERENCE_HISTORY_COLUMNS).filter(
        F.col("date").between(F.lit(start), F.lit(end))
    )


def history_window_at(spark: SparkSession, path: str, end: dt.date, days: int = S.HISTORY_DAYS) -> DataFrame:
    """S7 of a Parquet table by its path: the end date comes from the file footers, so of the table only the
    window's rows are read."""
    latest = footer_bounds(spark, path, "date")["date"][1]
    if latest != end:
        raise ContractError(f"History end date {latest} differs from the training cutoff {end}.")
    return history_window(spark.read.parquet(path), end, days, check_end=False)


def history_rules(history: DataFrame) -> DataFrame:
    return audit(
        history,
        {
            "null_base_key": F.greatest(*[F.col(k).isNull() for k in S.BASE_KEY]),
            "invalid_sales": F.col("sales").isNull() | (F.col("sales") < 0),
        },
        unique={"duplicate_base_key": S.BASE_KEY},
        non_empty=True,
    )


# ----------------------------------------------------------------------------- sinks

def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    overwrite: bool = False,
    partition_by: Sequence[str] | None = None,
    compression: str | None = None,
) -> str:
    """Refuse an existing output unless ``overwrite``; ISO dates in CSV.

    The job commit protocol makes the write atomic (no temp-file renames).
    """
    if not overwrite and path_exists(df.sparkSession, path):
        raise FileExistsError(f"Output already exists: {path}")
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_compact_history(df: DataFrame, end: dt.date, path: str, overwrite: bool = False) -> str:
    """Last 35 days, 4 columns, key-sorted, gzip CSV; validated before writing."""
    hist = history_window(df, end, check_end=False)
    last = hist.agg(F.max("date")).first()[0]
    if last != end:
        raise ContractError("Deployment history does not end at the training cutoff.")
    enforce(history_rules(hist), "deployment history")
    out = hist.repartitionByRange("date", "store_nbr", "family").sortWithinPartitions(*S.BASE_KEY)
    return write_table(out, path, fmt="csv", overwrite=overwrite, compression="gzip")


def read_compact_history(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, S.HISTORY_SCHEMA, fmt="csv")


def forecast_rules(forecast: DataFrame) -> DataFrame:
    """Column contract, non-empty, finite and non-negative predictions."""
    require_columns(forecast, S.FORECAST_COLUMNS, "forecast")
    v = F.col("forecast_sales")
    return audit(
        forecast,
        {"non_finite_forecast": ~is_finite(v), "negative_forecast": is_finite(v) & (v < 0)},
        non_empty=True,
    )


def publish_forecast(forecast: DataFrame, path: str, expected_rows: int | None = None) -> int:
    """S12 / S14 as a publication: V6 is measured while the rows are staged; readers see the whole forecast or
    the one before it (``read_published``). Returns the number of its manifest."""
    require_columns(forecast, S.FORECAST_COLUMNS, "forecast")
    v = F.col("forecast_sales")
    staged = stage(forecast, path, {"non_finite_forecast": ~is_finite(v), "negative_forecast": is_finite(v) & (v < 0)})
    if not staged.rows:
        staged = staged._replace(violations={**staged.violations, "non_empty": 1})
    return publish(forecast.sparkSession, staged, expected_rows)


def write_forecast(forecast: DataFrame, path: str, overwrite: bool = False, fmt: str = "csv") -> str:
    """Value rules first, then an atomic job write."""
    enforce(forecast_rules(forecast), "batch forecast", error=ValueError)
    return write_table(forecast, path, fmt=fmt, overwrite=overwrite)


__all__ = [
    "read_table", "csv_header", "read_csv_with_rejects", "REJECTED_LINE", "check_oil", "check_transactions", "check_holidays",
    "processed_contract", "processed_rules", "history_window", "history_window_at", "history_rules", "publish_forecast", "write_table", "write_compact_history",
    "read_compact_history", "forecast_rules", "write_forecast", "source_contracts", "ContractError",
]
