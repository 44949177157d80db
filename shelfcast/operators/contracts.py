"""Data contracts: a rule set becomes ONE aggregate pass and a (rule, violations) table.

``audit`` never triggers one job per rule: all row rules are ``count_if``
terms of a single ``agg``; each uniqueness rule is one ``groupBy(key)`` with
map-side partial counts (a hot key collapses before the shuffle).
``enforce`` collects only the tiny audit table and raises on violations.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping, NamedTuple, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.columns import count_if


#: Ids that one bitmap covers, its bytes, and bytes of bitmaps that are worth an id.
BITMAP_IDS = 32_768
BITMAP_BYTES = 4_096
LARGEST_BITMAP_SHARE = 1


class ContractError(ValueError):
    """A table violates its data contract."""


def _stack(agg_row: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn a one-row wide aggregate into (rule, violations) rows."""
    return agg_row.unpivot([], list(names), "rule", "violations").select(
        "rule", F.col("violations").cast("long").alias("violations")
    )


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both duplicate flavours: extra rows (``duplicated``) and all members (``keep=False``)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select("_n")
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("long").alias("extra_rows"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("long").alias("member_rows"),
    )


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """``extra_rows`` of one integer column, as ``duplicate_counts`` has them, by bitmaps where ids are dense.

    A bitmap of 4 KB holds 32,768 ids: tasks send one for each stretch of ids they meet, in place of the ids.
    That needs stretches that are filled: where the ids' range is too wide for their number (measured first),
    they are grouped as any other key.
    """
    seen = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if not seen.n or (seen.hi - seen.lo) // BITMAP_IDS * BITMAP_BYTES > LARGEST_BITMAP_SHARE * seen.n:
        return duplicate_counts(df, [column]).select("extra_rows")
    ids = df.select(F.col(column).cast("long").alias("_id"))
    bitmaps = ids.groupBy(F.bitmap_bucket_number("_id").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("_bits"),
        F.count("_id").alias("_n"),
        count_if(F.col("_id").isNull()).alias("_null"),
    )
    # Nulls are one group of their own, like in a group-by.
    nulls = F.greatest(F.coalesce(F.sum("_null"), F.lit(0)) - 1, F.lit(0))
    distinct = F.sum(F.when(F.col("_n") > 0, F.bitmap_count("_bits")).otherwise(0))
    return bitmaps.agg((F.coalesce(F.sum("_n") - distinct, F.lit(0)) + nulls).cast("long").alias("extra_rows"))


def audit(
    df: DataFrame,
    row_rules: Mapping[str, Column] | None = None,
    unique: Mapping[str, Sequence[str]] | None = None,
    non_empty: bool = False,
) -> DataFrame:
    """Evaluate a rule set. ``row_rules`` map rule name -> violation predicate.

    ``unique`` maps rule name -> key columns whose extra duplicate rows count
    as violations. ``non_empty`` adds a ``non_empty`` rule (1 if no rows).
    """
    parts: list[DataFrame] = []
    row_rules = dict(row_rules or {})
    aggs = [count_if(cond).alias(name) for name, cond in row_rules.items()]
    names = list(row_rules)
    if non_empty:
        aggs.append(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("non_empty"))
        names.append("non_empty")
    if aggs:
        parts.append(_stack(df.agg(*aggs), names))
    for name, keys in (unique or {}).items():
        dense = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.IntegralType)
        counted = duplicate_ids(df, keys[0]) if dense else duplicate_counts(df, keys)
        parts.append(counted.select(F.lit(name).alias("rule"), F.col("extra_rows").alias("violations")))
    if not parts:
        raise ValueError("audit needs at least one rule")
    return reduce(DataFrame.unionByName, parts)


def enforce(audit_df: DataFrame, context: str = "", error: type[Exception] = ContractError) -> DataFrame:
    """Raise ``error`` listing every failing rule; return the audit otherwise."""
    rows = audit_df.collect()
    failed = sorted((r.rule, int(r.violations)) for r in rows if r.violations)
    if failed:
        detail = ", ".join(f"{rule}={n}" for rule, n in failed)
        raise error(f"{context} violates its contract: {detail}".strip())
    return audit_df


class Contract(NamedTuple):
    """The rules of one table, not yet evaluated (see ``audit``)."""

    df: DataFrame
    row_rules: Mapping[str, Column]
    unique: Mapping[str, Sequence[str]] = {}
    non_empty: bool = False

    def audit(self) -> DataFrame:
        return audit(self.df, self.row_rules, self.unique, self.non_empty)


def _key(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """A key as (day, number, text), so that keys of several tables share one shuffle; what finds its place
    taken goes into the text as JSON."""
    place: dict[str, Column] = {}
    rest = []
    for name in columns:
        kind = df.schema[name].dataType
        slot = "day" if isinstance(kind, T.DateType) else "number" if isinstance(kind, T.IntegralType) else "text"
        if slot in place or (slot == "text" and not isinstance(kind, T.StringType)):
            rest.append(name)
        else:
            place[slot] = F.col(name)
    if rest:
        held = [place.pop("text")] if "text" in place else []
        place["text"] = F.to_json(F.struct(*rest, *[c.alias("_text") for c in held]), {"ignoreNullFields": "false"})
    types = {"day": "date", "number": "long", "text": "string"}
    return [place.get(slot, F.lit(None)).cast(kind).alias(slot) for slot, kind in types.items()]


def measure_all(contracts: Mapping[str, Contract]) -> dict[str, dict[str, int]]:
    """Violations by table and rule, and the table's ``rows``, all from one action that reads each table once.

    Row rules are observed while the rows pass on to the uniqueness count; that counts the keys of all
    rules of all tables in one partial aggregate.
    """
    watched, parts, rules = {}, [], []
    for name, contract in contracts.items():
        watched[name] = watch = Observation()
        counts = [count_if(bad).alias(rule) for rule, bad in contract.row_rules.items()]
        rows = contract.df.observe(watch, F.count(F.lit(1)).alias("_rows"), *counts)
        keys = []
        for rule, columns in contract.unique.items():
            keys.append(F.struct(F.lit(len(rules)).alias("rule"), *_key(contract.df, columns)))
            rules.append((name, rule))
        if not keys:  # nothing to count, but the rows have to pass
            keys = [F.struct(F.lit(-1).alias("rule"), *_key(contract.df, []))]
        parts.append(rows.select(F.explode(F.array(*keys)).alias("k")).select("k.*"))
    counts = reduce(DataFrame.unionByName, parts).groupBy("rule", "day", "number", "text").agg(F.count(F.lit(1)).alias("c"))
    # One aggregate without a filter: what is only observed must not be pruned, nor an empty result cut the plan.
    extra = [F.sum(F.when(F.col("rule") == k, F.col("c") - 1)).alias(f"r{k}") for k in range(len(rules))]
    repeated = counts.agg(F.count(F.lit(1)), *extra).first()
    found: dict[str, dict[str, int]] = {}
    for name, contract in contracts.items():
        seen = _observed(watched[name], contract)
        found[name] = {rule: int(seen.get(rule) or 0) for rule in contract.row_rules}
        if contract.non_empty:
            found[name]["non_empty"] = int(not seen["_rows"])
        found[name] |= {rule: 0 for rule in contract.unique}
        found[name]["rows"] = int(seen["_rows"])
    for k, (name, rule) in enumerate(rules):
        found[name][rule] = int(repeated[f"r{k}"] or 0)
    return found


def _observed(watch: Observation, contract: Contract) -> dict[str, int]:
    """The metrics of a watch. Where adaptive execution found a table empty it leaves it out of the plan, and
    with it the watch."""
    try:
        return watch.get
    except Py4JError:
        if not contract.df.isEmpty():
            raise
        return {"_rows": 0}


def enforce_all(contracts: Mapping[str, Contract], error: type[Exception] = ContractError) -> dict[str, int]:
    """``enforce`` for several tables by one action; the first failing table is named with all it breaks.
    Returns the rows of each."""
    found = measure_all(contracts)
    rows = {name: found[name].pop("rows") for name in contracts}
    for name in contracts:
        failed = sorted(f"{rule}={n}" for rule, n in found[name].items() if n)
        if failed:
            raise error(f"{name} violates its contract: {', '.join(failed)}")
    return rows


def null_rules(columns: Iterable[str], prefix: str = "null_") -> dict[str, Column]:
    return {f"{prefix}{c}": F.col(c).isNull() for c in columns}


def require_columns(df: DataFrame, expected: Sequence[str], name: str = "table", exact: bool = True) -> None:
    """Strict ordered-header contract (driver-side metadata, no job)."""
    actual = list(df.columns)
    if exact and actual != list(expected):
        raise ContractError(f"{name} columns differ from the contract. Expected {list(expected)}, received {actual}.")
    if not exact:
        missing = [c for c in expected if c not in actual]
        if missing:
            raise ContractError(f"{name} is missing columns: {missing}")


def forbid_columns(df: DataFrame, forbidden: Sequence[str], name: str = "table") -> None:
    present = [c for c in forbidden if c in df.columns]
    if present:
        raise ContractError(f"{name} must not contain {present}.")
