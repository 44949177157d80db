"""JSON record batches (S17, S18) and the per-record contract (V8).

Records travel as JSON Lines (one record per line) so a batch splits across
tasks; the ``{"records": [...]}`` envelope of a single request is also
accepted (``read_envelope``) and exploded into rows. A record is rejected
when it carries a key outside the contract (found with
``json_object_keys`` since ``from_json`` silently ignores extras), misses a
required field, has a field of the wrong type, or breaks a range rule.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast import schemas as S
from shelfcast.operators.contracts import audit

OPTIONAL_FIELDS = set(S.OIL_FEATURE_COLUMNS + S.TRANSACTION_LAG_COLUMNS)
NON_NEGATIVE_OPTIONAL = set(S.OIL_AGE_COLUMNS + S.TRANSACTION_LAG_COLUMNS)
# Range rules (fixed values): field -> (min, max); None means unbounded.
RANGES = {
    "id": (0, None),
    "store_nbr": (1, None),
    "onpromotion": (0, None),
    "store_cluster": (1, None),
    "month": (1, 12),
    "day_of_month": (1, 31),
    "day_of_week": (1, 7),
    "transactions_lag_available_count": (0, 4),
    **{f: (0, 1) for f in S.HOLIDAY_FEATURE_COLUMNS},
}
NON_EMPTY_STRINGS = ["family", "city", "state", "store_type"]


def to_records(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON object per row (ISO dates, every key present, nulls written) in column ``record``."""
    cols = columns or df.columns
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """A request body ``{"records": [...]}`` -> one JSON string per record; a refused body gives none."""
    return open_envelopes(spark.read.text(path, wholetext=True), "value")[0]


def open_envelopes(df: DataFrame, body_col: str) -> tuple[DataFrame, DataFrame]:
    """(one JSON string per record of the accepted bodies, refused bodies with their reason).

    A body is refused if it is no JSON object, has a top-level key besides
    ``records``, or holds no record.
    """
    body = F.col(body_col)
    keys = F.json_object_keys(body)
    records = F.from_json(body, "records array<string>").getField("records")
    reason = (
        F.when(keys.isNull(), "unparseable_body")
        .when(~F.array_contains(keys, "records"), "no_records_key")
        .when(F.size(keys) > 1, "extra_keys")
        .when(F.coalesce(F.size(records), F.lit(0)) < 1, "no_records")
    )
    staged = df.select(body.alias("body"), records.alias("records"), reason.alias("reason"))
    good = staged.filter("reason IS NULL").select(F.explode("records").alias("record"))
    return good, staged.filter("reason IS NOT NULL").select("body", "reason")


def _rule_columns(parsed: Column, record: Column, schema: T.StructType) -> dict[str, Column]:
    names = [f.name for f in schema.fields]
    keys = F.json_object_keys(record)
    readable = keys.isNotNull()
    raw = F.from_json(record, "map<string,string>")
    rules: dict[str, Column] = {
        "unparseable_record": ~readable,
        "extra_keys": readable & (F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0),
    }
    # Every key has to be there; only an optional field may be null; a value that its type cannot hold is a fault.
    absent = F.size(F.array_except(F.array(*[F.lit(n) for n in names]), keys)) > 0
    faults = [absent]
    for n in names:
        value = parsed.getField(n)
        faults.append(value.isNull() if n not in OPTIONAL_FIELDS else value.isNull() & raw[n].isNotNull())
    rules["missing_or_invalid_field"] = readable & reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in faults])
    out_of_range = []
    for n, (lo, hi) in RANGES.items():
        v = parsed.getField(n)
        if lo is not None:
            out_of_range.append(v < lo)
        if hi is not None:
            out_of_range.append(v > hi)
    out_of_range += [parsed.getField(n) < 0 for n in NON_NEGATIVE_OPTIONAL]
    out_of_range += [F.length(parsed.getField(n)) < 1 for n in NON_EMPTY_STRINGS]
    rules["out_of_range"] = readable & reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in out_of_range])
    return rules


def parse_records(
    df: DataFrame, json_col: str = "record", schema: T.StructType = S.RECORD_SCHEMA, carry: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """S17 + V8: (valid typed rows in contract order, rejected rows with their reasons); both keep the ``carry`` columns."""
    rec = F.col(json_col)
    parsed = F.from_json(rec, schema, {"mode": "PERMISSIVE"})
    staged = df.select(rec.alias("_record"), parsed.alias("_p"), *carry)
    rules = _rule_columns(F.col("_p"), F.col("_record"), schema)
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    staged = staged.withColumn("_reasons", reasons)
    valid = staged.filter(F.size("_reasons") == 0).select("_p.*", *carry)
    rejected = staged.filter(F.size("_reasons") > 0).select(F.col("_record").alias("record"), F.col("_reasons").alias("reasons"), *carry)
    return valid, rejected


def record_rules(df: DataFrame, json_col: str = "record", schema: T.StructType = S.RECORD_SCHEMA) -> DataFrame:
    """V8 as an audit table (rule, violations) over a record batch."""
    rec = F.col(json_col)
    parsed = F.from_json(rec, schema, {"mode": "PERMISSIVE"})
    staged = df.select(rec.alias("_record"), parsed.alias("_p"))
    return audit(staged, _rule_columns(F.col("_p"), F.col("_record"), schema), non_empty=True)
