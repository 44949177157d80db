"""Registered queries: one per operator of the inventory, each with its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator on the
store-sales tables Spark derives from the driver's parquet files;
``ORACLES[name]`` is the same result in DuckDB SQL (absent for operators
that SQL cannot express: model fitting, streaming).
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property, reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import asof as AO
from shelfcast.operators import contracts as CT
from shelfcast.operators import holidays as H
from shelfcast.operators import joins as J
from shelfcast.operators import keyed_history as KH
from shelfcast.operators import metrics as M
from shelfcast.operators.contracts import enforce
from shelfcast.plans import features as FT
from shelfcast.sources import oracle as O
from shelfcast.sources import readers as R
from shelfcast.sources import testdata as TD
from shelfcast.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle_body: str | None = None):
    def deco(fn: Callable[["Ctx"], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ctx_for(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle_body is not None:
            ORACLES[name] = O.sql(oracle_body)
        return fn

    return deco


_CONTEXTS: dict[tuple[str, str], "Ctx"] = {}


def ctx_for(spark: SparkSession, sf_dir: str) -> "Ctx":
    """One context per (application, input folder): derived tables are built,
    validated and materialised once per session and shared by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CONTEXTS:
        _CONTEXTS[key] = Ctx(spark, sf_dir)
    return _CONTEXTS[key]


class Ctx:
    """Per-query access to the derived tables (lazy, memoised within one query)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.src = TD.Source(spark, sf_dir)

    @property
    def win(self):
        """Evaluation windows, counted back from the last ship date."""
        return self.src.windows

    @cached_property
    def sales(self) -> DataFrame:
        return self.src.sales().cache()

    @cached_property
    def future(self) -> DataFrame:
        return self.src.future().cache()

    @cached_property
    def stores(self) -> DataFrame:
        return self.src.stores().cache()

    @cached_property
    def oil(self) -> DataFrame:
        return self.src.oil().cache()

    @cached_property
    def transactions(self) -> DataFrame:
        return self.src.transactions().cache()

    @cached_property
    def holidays(self) -> DataFrame:
        return self.src.holidays().cache()

    @cached_property
    def raw(self) -> FT.RawTables:
        return FT.RawTables(self.sales, self.future, self.stores, self.oil, self.transactions, self.holidays)

    @cached_property
    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Validated feature tables, checkpointed into the shared checkpoint folder
        (lineage cut: later plans start from the written table)."""
        return FT.publish_feature_tables(self.raw)

    @property
    def features(self) -> DataFrame:
        return self.tables[0]

    @property
    def future_features(self) -> DataFrame:
        return self.tables[1]

    @cached_property
    def labeled_lagged(self) -> DataFrame:
        return materialize(FT.add_sales_lags(self.features, self.sales), "labeled_lagged")

    @cached_property
    def store_dates(self) -> DataFrame:
        return self.sales.select("date", "store_nbr").unionByName(self.future.select("date", "store_nbr")).distinct()

    @cached_property
    def diagnostics(self) -> DataFrame:
        """Internal-test rows of the feature table with the stand-in forecast and segments."""
        f = self.features.filter(
            F.col("date").between(TD.d(self.win.internal_test_start), TD.d(self.win.internal_test_end))
        )
        pred = F.col("sales") * (F.lit(80) + F.lit(5) * (F.col("store_nbr") % 9)).cast("double") / F.lit(100.0)
        f = f.withColumn("predicted_sales", pred)
        return M.segments(M.forecast_day(f))


W = O.W

# ============================================================================ sources

@register("scan_base", "SELECT * FROM sales")
def scan_base(c: Ctx) -> DataFrame:
    """Labeled base table with its V1 contract enforced."""
    enforce(J.base_rules(c.sales), "train")
    return c.sales


@register("scan_future", "SELECT * FROM future")
def scan_future(c: Ctx) -> DataFrame:
    """Future base table (no target), V1 enforced."""
    enforce(J.base_rules(c.future), "test")
    return c.future


@register("scan_stores", "SELECT * FROM stores")
def scan_stores(c: Ctx) -> DataFrame:
    """Store metadata with ``type``/``cluster`` renamed; V2 enforced."""
    enforce(J.store_rules(c.stores), "stores")
    return c.stores


@register("scan_oil", "SELECT * FROM oil")
def scan_oil(c: Ctx) -> DataFrame:
    """S3."""
    R.check_oil(c.oil)
    return c.oil


@register("scan_transactions", "SELECT * FROM transactions")
def scan_transactions(c: Ctx) -> DataFrame:
    """S4."""
    R.check_transactions(c.transactions)
    return c.transactions


@register("scan_holidays", "SELECT * FROM holidays")
def scan_holidays(c: Ctx) -> DataFrame:
    """S5."""
    R.check_holidays(c.holidays)
    return c.holidays


@register("scan_template", "SELECT * FROM template")
def scan_template(c: Ctx) -> DataFrame:
    """Submission template."""
    return c.src.template()


def _as_csv(c: Ctx, name: str, df: DataFrame) -> str:
    """A derived table as a CSV folder, written once per context."""
    written = c.__dict__.setdefault("_csv", {})
    if name not in written:
        written[name] = R.write_table(df, new_output_path(c.spark, f"csv-{name}"), fmt="csv")
    return written[name]


_CSV_TABLES = {"base": "sales", "future": "future", "stores": "stores", "oil": "oil", "transactions": "transactions", "holidays": "holidays"}


def _scan_csv(name: str, table: str):
    def run(c: Ctx) -> DataFrame:
        source = getattr(c, table)
        return R.read_table(c.spark, _as_csv(c, table, source), source.schema, fmt="csv")

    run.__doc__ = f"S1-S5: the {table} table scanned from CSV with its schema."
    return run


for _name, _table in _CSV_TABLES.items():
    register(f"scan_{_name}_csv", f"SELECT * FROM {_table}")(_scan_csv(_name, _table))


@register("csv_header", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, {i} AS position, '{x}' AS column_name WHERE (SELECT count(*) FROM {t}) > 0"
    for t, columns in (("sales", S.TRAIN_COLUMNS), ("oil", S.OIL_COLUMNS), ("transactions", S.TRANSACTION_COLUMNS), ("holidays", S.HOLIDAY_COLUMNS))
    for i, x in enumerate(columns)))
def csv_header(c: Ctx) -> DataFrame:
    """The headers that the CSV tables have."""
    tables = ("sales", "oil", "transactions", "holidays")
    rows = [(t, i, x) for t in tables for i, x in enumerate(R.csv_header(c.spark, _as_csv(c, t, getattr(c, t))))]
    return c.spark.createDataFrame(rows, "table_name string, position int, column_name string")


_CSV_FAULTS = """SELECT CASE WHEN (store_nbr + day(date)) % 7 = 1 THEN 'short' WHEN (store_nbr + day(date)) % 7 = 2 THEN 'long'
  WHEN (store_nbr + day(date)) % 7 = 3 THEN 'word' WHEN (store_nbr + day(date)) % 7 = 4 THEN 'day' ELSE 'none' END AS fault, * FROM transactions"""


@register("scan_rejects", f"""SELECT fault, reason, count(*) AS lines, CAST(COALESCE(sum(transactions), 0) AS BIGINT) AS transactions FROM
  (SELECT fault, CASE WHEN fault IN ('short', 'long') THEN 'field_count' WHEN fault IN ('word', 'day') THEN 'bad_value' ELSE 'accepted' END AS reason,
          CASE WHEN fault = 'none' THEN transactions END AS transactions FROM ({_CSV_FAULTS})) GROUP BY fault, reason""")
def scan_rejects(c: Ctx) -> DataFrame:
    """A CSV table with lines too short, too long, with a word for a number and with no such day; every line
    is either a typed row or a reject with its reason."""
    k = (F.col("store_nbr") + F.dayofmonth("date")) % 7
    day, store, n = F.col("date").cast("string"), F.col("store_nbr").cast("string"), F.col("transactions").cast("string")
    line = (
        F.when(k == 1, F.concat_ws(",", day, store))
        .when(k == 2, F.concat_ws(",", day, store, n, F.lit("more")))
        .when(k == 3, F.concat_ws(",", day, store, F.concat(F.lit("word "), n)))
        .when(k == 4, F.concat_ws(",", F.concat(F.lit("2001-02-30x"), day), store, n))
        .otherwise(F.concat_ws(",", day, store, n))
    )
    path = new_output_path(c.spark, "csv-dirty")
    # One text file with a header, as a producer would write it.
    header = F.lit(",".join(S.TRANSACTION_COLUMNS))
    body = c.transactions.select(line.alias("value"), F.lit(1).alias("at"))
    c.spark.range(1).select(header.alias("value"), F.lit(0).alias("at")).unionByName(body).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    good, bad = R.read_csv_with_rejects(c.spark, path, c.transactions.schema)
    fault = (
        F.when(F.col("reason") == "bad_value", F.when(F.col(R.REJECTED_LINE).contains("word"), "word").otherwise("day"))
        .otherwise(F.when(F.col(R.REJECTED_LINE).contains("more"), "long").otherwise("short"))
    )
    rows = good.select(F.lit("none").alias("fault"), F.lit("accepted").alias("reason"), "transactions").unionByName(
        bad.select(fault.alias("fault"), "reason", F.lit(None).cast("int").alias("transactions"))
    )
    return rows.groupBy("fault", "reason").agg(
        F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("transactions"), F.lit(0)).cast("long").alias("transactions")
    )


# ============================================================================ joins

@register("asof_events", """SELECT p.event_id, p.user_id, p.ts, max_by(v.value, (v.ts, v.event_id)) AS value, max(v.ts) AS matched_time
FROM events p LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts
WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id, p.ts""")
def asof_events(c: Ctx) -> DataFrame:
    """J3 at event grain: each purchase with the last view of its user at or before it."""
    events = c.src.raw("events").select("event_id", "user_id", "ts", "value", "event_type")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return AO.asof_join(bought, events.where("event_type = 'view'"), ["user_id"], "ts", ["value"], tie="event_id")


@register("dup_ids", f"""SELECT 'sales' AS table_name, {O.extra_rows('sales', ['id'])} AS extra_rows
UNION ALL SELECT 'future', {O.extra_rows('future', ['id'])} UNION ALL SELECT 'orders', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'lineitem', count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem""")
def dup_ids(c: Ctx) -> DataFrame:
    """Rows that repeat an id, by bitmaps where ids are dense."""
    tables = {"sales": (c.sales, "id"), "future": (c.future, "id"),
              "orders": (c.src.raw("orders"), "o_orderkey"), "lineitem": (c.src.raw("lineitem"), "l_orderkey")}
    parts = [CT.duplicate_ids(df, x).select(F.lit(name).alias("table_name"), "extra_rows") for name, (df, x) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@register(
    "store_join",
    "SELECT s.*, st.city, st.state, st.store_type, st.store_cluster FROM sales s LEFT JOIN stores st ON s.store_nbr = st.store_nbr",
)
def store_join(c: Ctx) -> DataFrame:
    """Guarded m:1 store join."""
    return J.store_join(c.sales, c.stores, "train")


@register(
    "calendar_features",
    "SELECT *, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day_of_month, "
    "CAST(isodow(date) AS INTEGER) AS day_of_week FROM sales",
)
def calendar_features(c: Ctx) -> DataFrame:
    """P10."""
    return J.add_calendar_features(c.sales)


_SAL_SEL, _SAL_JOIN = O._lags("sales", "sales", ["store_nbr", "family"], "sales", "f")


@register("exact_lags_sales", f"SELECT f.*, {_SAL_SEL} FROM sales f {_SAL_JOIN}")
def exact_lags_sales(c: Ctx) -> DataFrame:
    """Exact sales lags 16/21/28/35 + available count (missing stays missing)."""
    return FT.add_sales_lags(c.sales, c.sales)


@register("batch_lags_keyed", f"SELECT f.id, f.date, f.store_nbr, f.family, {_SAL_SEL} FROM future f {_SAL_JOIN}")
def batch_lags_keyed(c: Ctx) -> DataFrame:
    """J5 / J9 of the future batch on a history laid out by (store, family): the history is not exchanged."""
    kept = KH.read_history(c.spark, KH.write_history(c.sales))
    J.require_pair_coverage(c.future, kept)
    return KH.batch_lags(c.future.select("id", "date", "store_nbr", "family"), kept, c.win.internal_test_end)


@register("asof_lags", "SELECT * FROM oil_lookup")
def asof_lags(c: Ctx) -> DataFrame:
    """Backward as-of oil value + age for every base date and safe lag."""
    dates = c.store_dates.select("date").distinct()
    return FT.oil_lookup(dates, c.oil)


@register("exact_lags_store", "SELECT * FROM txn_lookup")
def exact_lags_store(c: Ctx) -> DataFrame:
    """Exact transaction lags per base store-date + available count."""
    from shelfcast.functions.columns import nonnull_count

    lk = FT.transaction_lookup(c.transactions)
    return c.store_dates.join(lk, ["date", "store_nbr"], "left").withColumn(
        "transactions_lag_available_count", nonnull_count(S.TRANSACTION_LAG_COLUMNS)
    )


@register(
    "holiday_flags",
    "SELECT h.* FROM holiday_lookup h JOIN store_dates sd ON h.date = sd.date AND h.store_nbr = sd.store_nbr",
)
def holiday_flags(c: Ctx) -> DataFrame:
    """H1: 8 flags per (date, store) reached by a scheduled event, over the base store-dates."""
    return H.holiday_flags(c.holidays, c.stores, c.store_dates)


@register("feature_table", "SELECT * FROM features")
def feature_table(c: Ctx) -> DataFrame:
    """The 34-column labeled feature table."""
    return c.features


@register("labeled_with_sales_lags", "SELECT * FROM labeled_lagged")
def labeled_with_sales_lags(c: Ctx) -> DataFrame:
    """M13 + J5: the 39-column labeled table used for fitting (flagship)."""
    return c.labeled_lagged


@register("scan_processed", "SELECT * FROM future_features")
def scan_processed(c: Ctx) -> DataFrame:
    """The 33-column future feature table with its processed-table contract enforced."""
    enforce(R.processed_rules(c.future_features, has_target=False), "future features")
    return c.future_features


# ============================================================================ metrics

def _err_sql(by: list[str]) -> str:
    g = ", ".join(by)
    m = "CAST(sum(CAST(predicted_sales - sales AS DECIMAL(28,8))) AS DOUBLE)"
    a = "CAST(sum(CAST(abs(predicted_sales - sales) AS DECIMAL(28,8))) AS DOUBLE)"
    s = "CAST(sum(CAST(sales AS DECIMAL(28,8))) AS DOUBLE)"
    tot = "(SELECT CAST(sum(CAST(abs(predicted_sales - sales) AS DECIMAL(28,8))) AS DOUBLE) FROM diagnostics)"
    return f"""SELECT {g}, count(*) AS rows, {s} AS actual_sales,
  CAST(sum(CAST(predicted_sales AS DECIMAL(28,8))) AS DOUBLE) AS predicted_sales,
  {a} AS absolute_error,
  round(sqrt(avg(pow(ln(1 + predicted_sales) - ln(1 + sales), 2))), 6) AS rmsle,
  round({a} / nullif({s}, 0) * 100.0, 6) AS wape_pct,
  round({m} / nullif({s}, 0) * 100.0, 6) AS signed_bias_pct,
  round({a} / nullif({tot}, 0) * 100.0, 6) AS error_contribution_pct
FROM diagnostics GROUP BY {g}"""


for _name, _by in {
    "error_summary_day": ["forecast_day", "date"],
    "error_summary_store": ["store_nbr"],
    "error_summary_family": ["family"],
    "error_summary_promo": ["promotion_segment"],
    "error_summary_holiday": ["holiday_segment"],
}.items():
    def _mk(by):
        def q(c: Ctx) -> DataFrame:
            return M.error_summary(c.diagnostics, by)
        q.__doc__ = f"A14: segmented forecast errors by {by}."
        return q

    register(_name, _err_sql(_by))(_mk(_by))


# ============================================================================ batch 2: profiles, exploration, splits
from shelfcast.operators import explore as X  # noqa: E402
from shelfcast.operators import guards as G  # noqa: E402
from shelfcast.operators import profile as P  # noqa: E402
from shelfcast.operators import splits as SP  # noqa: E402

DBL100 = "CAST(100 AS DOUBLE)"
TRAIN_SQL = f"(SELECT * FROM features WHERE date <= {W['train_end']})"
MONEY_SQL = "DECIMAL(28,8)"


def _train(c: Ctx) -> DataFrame:
    return c.features.filter(F.col("date") <= F.lit(c.win.train_end))


def _profile_sql(name: str, table: str, cols: list[str], key: list[str], has_date: bool) -> str:
    dates = "min(date) AS date_min, max(date) AS date_max" if has_date else \
        "CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_max"
    return (f"SELECT '{name}' AS table_name, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns, "
            f"CAST({O.null_cells(cols)} AS BIGINT) AS missing_cells, {dates}, "
            f"{O.member_rows(table, key)} AS duplicate_key_rows FROM {table}")


_PROFILE_TABLES = [
    ("sales", S.TRAIN_COLUMNS, S.BASE_KEY, True),
    ("stores", ["store_nbr"] + S.STORE_OUTPUT_COLUMNS, ["store_nbr"], False),
    ("oil", S.OIL_COLUMNS, ["date"], True),
    ("transactions", S.TRANSACTION_COLUMNS, ["date", "store_nbr"], True),
    ("holidays", S.HOLIDAY_COLUMNS, ["date"], True),
]


@register("table_profile", "\nUNION ALL\n".join(_profile_sql(n, n, c, k, d) for n, c, k, d in _PROFILE_TABLES))
def table_profile(c: Ctx) -> DataFrame:
    """A1: one profile row per source table."""
    frames = {"sales": c.sales, "stores": c.stores, "oil": c.oil, "transactions": c.transactions, "holidays": c.holidays}
    out = None
    for n, _cols, k, d in _PROFILE_TABLES:
        p = P.table_profile(frames[n], n, k, "date" if d else None)
        out = p if out is None else out.unionByName(p)
    return out


@register("dup_counts", f"SELECT {O.extra_rows('holidays', ['date'])} AS extra_rows, {O.member_rows('holidays', ['date'])} AS member_rows")
def dup_counts(c: Ctx) -> DataFrame:
    """Both duplicate flavours on the holiday calendar's date."""
    from shelfcast.operators.contracts import duplicate_counts

    return duplicate_counts(c.holidays, ["date"])


_GAPS_SQL = ("(SELECT CAST(d AS DATE) AS absent_date FROM (SELECT unnest(generate_series((SELECT min(date) FROM features), "
             "(SELECT max(date) FROM features), INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT date FROM features))")


@register("calendar_gaps", f"SELECT * FROM {_GAPS_SQL}")
def calendar_gaps(c: Ctx) -> DataFrame:
    """Calendar dates with no labeled row."""
    return J.calendar_gaps(c.features)


@register("raw_conditions", f"""SELECT count(*) AS sales_rows,
  count(*) FILTER (WHERE sales = 0) AS zero_sales_rows,
  count(*) FILTER (WHERE sales % 1 <> 0) AS fractional_sales_rows,
  count(*) FILTER (WHERE onpromotion > 0) AS promoted_rows,
  round({DBL100} * CAST(count(*) FILTER (WHERE onpromotion > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS promoted_rate_pct,
  (SELECT count(*) FROM oil WHERE dcoilwtico IS NULL) AS missing_oil_prices,
  (SELECT count(*) FROM {_GAPS_SQL}) AS calendar_gap_dates,
  {O.member_rows('holidays', ['date'])} AS nonunique_holiday_date_rows,
  round({DBL100} * CAST(count(*) FILTER (WHERE sales = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS zero_sales_rate_pct,
  (SELECT count(*) FROM events_classified WHERE is_planned) AS planned_event_rows,
  (SELECT count(*) FROM events_classified WHERE is_earthquake) AS earthquake_event_rows,
  (SELECT count(*) FROM events_classified WHERE ntype = 'event' AND NOT is_planned AND NOT is_earthquake) AS unknown_event_rows,
  (SELECT COALESCE(string_agg(CAST(absent_date AS VARCHAR), ', ' ORDER BY absent_date), '') FROM {_GAPS_SQL}) AS calendar_gap_list
FROM sales""")
def raw_conditions(c: Ctx) -> DataFrame:
    """A2."""
    return P.raw_conditions(c.sales, c.oil, c.holidays, J.calendar_gaps(c.features))


@register("raw_conditions_dirty", """SELECT count(*) FILTER (WHERE id % 9 = 0) AS zero_sales_rows,
  round(CAST(100.0 AS DOUBLE) * CAST(count(*) FILTER (WHERE id % 9 = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS zero_sales_rate_pct,
  (SELECT count(*) FROM events_classified WHERE ntype = 'event') AS unknown_event_rows, CAST(0 AS BIGINT) AS planned_event_rows,
  (SELECT count(DISTINCT date) FROM features WHERE day(date) = 15 AND date > (SELECT min(date) FROM features) AND date < (SELECT max(date) FROM features)) AS calendar_gap_dates,
  (SELECT string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) FROM (SELECT DISTINCT date FROM features WHERE day(date) = 15
     AND date > (SELECT min(date) FROM features) AND date < (SELECT max(date) FROM features))) AS calendar_gap_list FROM sales""")
def raw_conditions_dirty(c: Ctx) -> DataFrame:
    """A2 of sources with zero sales, events without a class, and every fifteenth of a month left out."""
    sales = c.sales.withColumn("sales", F.when(F.col("id") % 9 == 0, 0.0).otherwise(F.greatest("sales", F.lit(1.0))))
    holidays = c.holidays.withColumn("description", F.when(F.lower("type") == "event", "Unclassified Parade").otherwise(F.col("description")))
    gaps = J.calendar_gaps(c.features.where(F.dayofmonth("date") != 15))
    return P.raw_conditions(sales, c.oil, holidays, gaps).select(
        "zero_sales_rows", "zero_sales_rate_pct", "unknown_event_rows", "planned_event_rows", "calendar_gap_dates", "calendar_gap_list"
    )


_ALLOWED = S.ALLOWED_MISSING_COLUMNS


@register("before_after", f"""SELECT (SELECT count(*) FROM sales) AS raw_rows, count(*) AS final_rows,
  CAST({len(S.TRAIN_COLUMNS)} AS BIGINT) AS raw_columns, CAST({len(S.LABELED_COLUMNS)} AS BIGINT) AS final_columns,
  CAST({len(S.LABELED_COLUMNS) - len(S.TRAIN_COLUMNS)} AS BIGINT) AS added_columns,
  CAST({O.null_cells([x for x in S.LABELED_COLUMNS if x in _ALLOWED])} AS BIGINT) AS expected_gap_cells,
  CAST({O.null_cells([x for x in S.LABELED_COLUMNS if x not in _ALLOWED])} AS BIGINT) AS unexpected_missing_cells,
  {O.member_rows('features', S.BASE_KEY)} AS duplicate_key_rows
FROM features""")
def before_after(c: Ctx) -> DataFrame:
    """A3: raw base vs final feature table."""
    return P.reconcile(c.sales, c.features, S.BASE_KEY, _ALLOWED)


@register("calendar_audit", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column, CAST(min({x}) AS BIGINT) AS min, CAST(max({x}) AS BIGINT) AS max, "
    f"count(*) FILTER (WHERE {x} IS NULL) AS nulls FROM features" for x in S.CALENDAR_COLUMNS))
def calendar_audit(c: Ctx) -> DataFrame:
    """A4."""
    return P.column_audit(c.features, S.CALENDAR_COLUMNS)


_A5_ALLOWED = S.OIL_FEATURE_COLUMNS + S.TRANSACTION_LAG_COLUMNS


@register("structural_checks", f"""SELECT * FROM (SELECT
  CAST({O.null_cells([x for x in S.LABELED_COLUMNS if x in _A5_ALLOWED])} AS BIGINT) AS expected_history_gap_cells,
  CAST({O.null_cells([x for x in S.LABELED_COLUMNS if x not in _A5_ALLOWED])} AS BIGINT) AS unexpected_missing_cells,
  {O.extra_rows('features', S.BASE_KEY)} AS duplicate_date_store_family,
  count(*) FILTER (WHERE sales < 0) AS negative_sales_rows,
  count(DISTINCT date) AS unique_dates,
  (SELECT count(*) FROM {_GAPS_SQL}) AS missing_calendar_dates,
  count(DISTINCT store_nbr) AS unique_stores,
  count(DISTINCT family) AS unique_families
FROM features) UNPIVOT (value FOR "check" IN (expected_history_gap_cells, unexpected_missing_cells, duplicate_date_store_family,
  negative_sales_rows, unique_dates, missing_calendar_dates, unique_stores, unique_families))""")
def structural_checks(c: Ctx) -> DataFrame:
    """A5."""
    gaps = J.calendar_gaps(c.features).count()
    return P.structural_checks(c.features, _A5_ALLOWED, gaps)


@register("missing_audit", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column, count(*) FILTER (WHERE {x} IS NULL) AS missing_cells, "
    f"round({DBL100} * CAST(count(*) FILTER (WHERE {x} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS missing_rate_pct "
    f"FROM labeled_lagged HAVING count(*) FILTER (WHERE {x} IS NULL) > 0"
    for x in S.LABELED_COLUMNS + S.SALES_FEATURE_COLUMNS))
def missing_audit(c: Ctx) -> DataFrame:
    """Columns of the lagged labeled table that have nulls."""
    return P.missing_audit(c.labeled_lagged)


_SPLIT_SQL = (f"CASE WHEN date BETWEEN {W['internal_test_start']} AND {W['internal_test_end']} THEN 'internal_test' "
              f"WHEN date BETWEEN {W['validation_start']} AND {W['validation_end']} THEN 'validation' "
              f"WHEN date <= {W['train_end']} THEN 'train' ELSE 'unassigned' END")


@register("chrono_split", f"SELECT id, date, store_nbr, family, {_SPLIT_SQL} AS data_split FROM features")
def chrono_split(c: Ctx) -> DataFrame:
    """P7."""
    return SP.chrono_split(c.features, c.win).select("id", "date", "store_nbr", "family", "data_split")


@register("split_counts", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS data_split, {i} AS split_rank, count(*) FILTER (WHERE sp = '{s}') AS rows, "
    f"count(DISTINCT CASE WHEN sp = '{s}' THEN date END) AS observed_dates FROM (SELECT date, {_SPLIT_SQL} AS sp FROM features)"
    for i, s in enumerate(SP.SPLIT_ORDER)))
def split_counts(c: Ctx) -> DataFrame:
    """Empty splits shown with zero."""
    return SP.split_counts(SP.chrono_split(c.features, c.win))


_SPLIT_RULES = """SELECT 'unassigned_rows' AS rule, count(*) FILTER (WHERE date > {end}) AS violations FROM {table}
UNION ALL SELECT 'validation_dates_missing', 16 - count(DISTINCT date) FROM {table} WHERE date BETWEEN {vs} AND {ve}
UNION ALL SELECT 'internal_test_dates_missing', 16 - count(DISTINCT date) FROM {table} WHERE date BETWEEN {ts} AND {te}
UNION ALL SELECT 'non_empty', CAST(0 AS BIGINT)"""
_SPLIT_WINDOWS = {"end": W["internal_test_end"], "vs": W["validation_start"], "ve": W["validation_end"], "ts": W["internal_test_start"], "te": W["internal_test_end"]}


@register("check_splits", _SPLIT_RULES.format(table="features", **_SPLIT_WINDOWS))
def check_splits(c: Ctx) -> DataFrame:
    """P7 as a contract: every row has one split, and both evaluation windows are whole."""
    return SP.split_rules(SP.chrono_split(c.features, c.win), c.win)


_DIRTY_SPLITS = "(SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN date + 400 ELSE date END AS date) FROM features WHERE day(date) % 5 <> 2)"


@register("check_splits_dirty", _SPLIT_RULES.format(table=_DIRTY_SPLITS, **_SPLIT_WINDOWS))
def check_splits_dirty(c: Ctx) -> DataFrame:
    """P7 contract of a table with missing dates and rows after the last window."""
    dirty = c.features.where(F.dayofmonth("date") % 5 != 2)
    dirty = dirty.withColumn("date", F.when(F.col("id") % 7 == 0, F.date_add("date", 400)).otherwise(F.col("date")))
    return SP.split_rules(SP.chrono_split(dirty, c.win), c.win)


@register("date_window", f"SELECT * FROM sales WHERE date BETWEEN {W['validation_start']} AND {W['validation_end']}")
def date_window(c: Ctx) -> DataFrame:
    """P5: inclusive validation window."""
    return SP.date_window(c.sales, c.win.validation_start, c.win.validation_end)


@register("train_summary", f"""SELECT count(*) AS rows, min(date) AS start_date, max(date) AS end_date,
  count(DISTINCT date) AS observed_dates, count(DISTINCT store_nbr) AS stores, count(DISTINCT family) AS product_families,
  round({DBL100} * CAST(count(*) FILTER (WHERE sales = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS zero_sales_rate_pct,
  round({DBL100} * CAST(count(*) FILTER (WHERE onpromotion > 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS promotion_rows_pct
FROM {TRAIN_SQL}""")
def train_summary(c: Ctx) -> DataFrame:
    """A8."""
    return X.train_summary(_train(c))


_TOT = f"CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE)"
_MEAN = f"round({_TOT} / CAST(count(*) AS DOUBLE), 6)"
_ZR = f"round({DBL100} * CAST(count(*) FILTER (WHERE sales = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6)"
_FAMILY_SQL = f"SELECT family, {_TOT} AS total_sales, {_MEAN} AS average_daily_store_sales, {_ZR} AS zero_sales_rate_pct FROM {TRAIN_SQL} GROUP BY family"
_STORE_SQL = f"SELECT store_nbr, {_TOT} AS total_sales, {_MEAN} AS average_daily_family_sales FROM {TRAIN_SQL} GROUP BY store_nbr"


@register("family_summary", _FAMILY_SQL)
def family_summary(c: Ctx) -> DataFrame:
    """A9."""
    return X.family_summary(_train(c))


@register("store_summary", _STORE_SQL)
def store_summary(c: Ctx) -> DataFrame:
    """A10."""
    return X.store_summary(_train(c))


@register("top_families", f"SELECT * FROM ({_FAMILY_SQL}) ORDER BY total_sales DESC, family LIMIT 10")
def top_families(c: Ctx) -> DataFrame:
    """L2: top-10 families by total sales."""
    return X.top_k(X.family_summary(_train(c)), "total_sales", 10, ["family"])


@register("top_stores", f"SELECT * FROM ({_STORE_SQL}) ORDER BY total_sales DESC, store_nbr LIMIT 10")
def top_stores(c: Ctx) -> DataFrame:
    """L2: top-10 stores by total sales."""
    return X.top_k(X.store_summary(_train(c)), "total_sales", 10, ["store_nbr"])


@register("promotion_summary", f"""SELECT CASE WHEN onpromotion > 0 THEN 'with promotion' ELSE 'without promotion' END AS has_promotion,
  count(*) AS rows, {_MEAN} AS mean_sales, round(median(sales), 4) AS median_sales, {_ZR} AS zero_sales_rate_pct
FROM {TRAIN_SQL} GROUP BY 1""")
def promotion_summary(c: Ctx) -> DataFrame:
    """A11 (exact interpolated median)."""
    return X.promotion_summary(_train(c))


_CAL_GROUPS = {
    "weekday_non_holiday": "day_of_week NOT IN (6, 7) AND is_holiday <> 1",
    "weekend_non_holiday": "day_of_week IN (6, 7) AND is_holiday <> 1",
    "holiday": "is_holiday = 1",
}


@register("calendar_describe", "\nUNION ALL\n".join(
    f"SELECT '{g}' AS \"group\", count(*) AS count, round({_TOT} / CAST(count(*) AS DOUBLE), 4) AS mean, "
    f"round(median(sales), 4) AS median, round(stddev_samp(sales), 4) AS std FROM {TRAIN_SQL} WHERE {cond} HAVING count(*) > 0"
    for g, cond in _CAL_GROUPS.items()))
def calendar_describe(c: Ctx) -> DataFrame:
    """Weekday / weekend / holiday sales distribution."""
    return X.describe_where(_train(c), X.calendar_groups())


@register("findings", f"""SELECT {_ZR} AS zero_sales_rate_pct,
  (SELECT family FROM ({_FAMILY_SQL}) ORDER BY total_sales DESC, family LIMIT 1) AS top_family,
  (SELECT store_nbr FROM ({_STORE_SQL}) ORDER BY total_sales DESC, store_nbr LIMIT 1) AS top_store,
  round((CAST(sum(CAST(sales AS {MONEY_SQL})) FILTER (WHERE onpromotion > 0) AS DOUBLE) / CAST(count(*) FILTER (WHERE onpromotion > 0) AS DOUBLE))
   / nullif(CAST(sum(CAST(sales AS {MONEY_SQL})) FILTER (WHERE onpromotion <= 0) AS DOUBLE) / CAST(count(*) FILTER (WHERE onpromotion <= 0) AS DOUBLE), 0), 6) AS promotion_mean_ratio
FROM {TRAIN_SQL}""")
def findings(c: Ctx) -> DataFrame:
    """A20."""
    return X.findings(_train(c))


_DAILY_SQL = f"(SELECT date, {_TOT} AS daily_sales FROM {TRAIN_SQL} GROUP BY date)"


@register("rolling_28d", f"""SELECT d.date, d.daily_sales,
  CASE WHEN count(*) >= 7 THEN CAST(sum(CAST(w.daily_sales AS {MONEY_SQL})) AS DOUBLE) / CAST(count(*) AS DOUBLE) END AS rolling_28d_mean
FROM {_DAILY_SQL} d JOIN {_DAILY_SQL} w ON w.date BETWEEN d.date - 27 AND d.date GROUP BY d.date, d.daily_sales""")
def rolling_28d(c: Ctx) -> DataFrame:
    """28-calendar-day trailing mean of daily training sales, min 7 observations."""
    return X.rolling_mean(X.daily_sales(_train(c)))


_MS_SQL = ("(SELECT min(date) FROM labeled_lagged WHERE " + " AND ".join(
    f"{x} IS NOT NULL" for x in S.SALES_LAG_COLUMNS + S.OIL_LAG_COLUMNS) + ")")


@register("model_start", f"SELECT {_MS_SQL} AS model_start")
def model_start(c: Ctx) -> DataFrame:
    """First date with all sales and oil lags present."""
    start = SP.model_start(c.labeled_lagged)
    return c.spark.range(1).select(F.lit(start).cast("date").alias("model_start"))


_LABEL_SQL = (f"CASE WHEN date < {_MS_SQL} THEN 'Warm-up' WHEN date BETWEEN {_MS_SQL} AND {W['train_end']} THEN 'Train' "
              f"WHEN date BETWEEN {W['validation_start']} AND {W['validation_end']} THEN 'Validation' "
              f"WHEN date BETWEEN {W['internal_test_start']} AND {W['internal_test_end']} THEN 'Internal test' ELSE 'Unassigned' END")


@register("split_labels", f"SELECT id, date, {_LABEL_SQL} AS split FROM labeled_lagged")
def split_labels(c: Ctx) -> DataFrame:
    """P8."""
    start = SP.model_start(c.labeled_lagged)
    return SP.split_labels(c.labeled_lagged, c.win, start).select("id", "date", "split")


_HIST_COLS = S.SALES_LAG_COLUMNS + S.TRANSACTION_LAG_COLUMNS + S.OIL_LAG_COLUMNS


@register("missing_history", "SELECT split, " + ", ".join(
    f"round({DBL100} * CAST(count(*) FILTER (WHERE {x} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS {x}"
    for x in _HIST_COLS) + f" FROM (SELECT *, {_LABEL_SQL} AS split FROM labeled_lagged) GROUP BY split")
def missing_history(c: Ctx) -> DataFrame:
    """A17."""
    start = SP.model_start(c.labeled_lagged)
    return SP.missing_history(SP.split_labels(c.labeled_lagged, c.win, start), _HIST_COLS)


@register("pair_horizon", "SELECT store_nbr, family, count(DISTINCT date) AS forecast_dates FROM future GROUP BY store_nbr, family")
def pair_horizon(c: Ctx) -> DataFrame:
    """A18."""
    return SP.pair_horizon(c.future)


_PERIODS_SQL = f"""(SELECT 'Validation' AS period, min(date) AS forecast_start, max(date) AS forecast_end, {W['train_end']} AS cutoff
   FROM features WHERE date BETWEEN {W['validation_start']} AND {W['validation_end']}
 UNION ALL SELECT 'Internal test', min(date), max(date), {W['validation_end']}
   FROM features WHERE date BETWEEN {W['internal_test_start']} AND {W['internal_test_end']}
 UNION ALL SELECT 'Future', min(date), max(date), {W['internal_test_end']} FROM future)"""
_WINDOW_SQL = f"""SELECT period, forecast_start, forecast_end, cutoff,
  CAST(date_diff('day', forecast_start, forecast_end) + 1 AS INTEGER) AS days,
  CAST(forecast_end - 16 AS DATE) AS latest_lag_source, forecast_end - 16 <= cutoff AS all_lags_available_by_cutoff
FROM {_PERIODS_SQL}"""


def _periods(c: Ctx) -> DataFrame:
    def one(df: DataFrame, name: str, cutoff: dt.date) -> DataFrame:
        return df.agg(
            F.lit(name).alias("period"), F.min("date").alias("forecast_start"), F.max("date").alias("forecast_end"),
            F.lit(cutoff).cast("date").alias("cutoff"),
        )
    return (
        one(SP.date_window(c.features, c.win.validation_start, c.win.validation_end), "Validation", c.win.train_end)
        .unionByName(one(SP.date_window(c.features, c.win.internal_test_start, c.win.internal_test_end), "Internal test", c.win.validation_end))
        .unionByName(one(c.future, "Future", c.win.internal_test_end))
    )


@register("window_contract", _WINDOW_SQL)
def window_contract(c: Ctx) -> DataFrame:
    """Observed evaluation windows, their lag source and lag safety."""
    return SP.window_contract(_periods(c))


@register("segments", "SELECT id, promotion_segment, holiday_segment, is_weekend_group FROM diagnostics")
def segments(c: Ctx) -> DataFrame:
    """P9."""
    return c.diagnostics.select("id", "promotion_segment", "holiday_segment", "is_weekend_group")


@register("forecast_day", "SELECT id, date, forecast_day FROM diagnostics")
def forecast_day(c: Ctx) -> DataFrame:
    """P14."""
    return c.diagnostics.select("id", "date", "forecast_day")


@register("project_contract", f"SELECT {', '.join(S.FUTURE_COLUMNS)} FROM features")
def project_contract(c: Ctx) -> DataFrame:
    """The labeled table projected to the future contract (column subset + order)."""
    return c.features.select(*S.FUTURE_COLUMNS)


# ---------------------------------------------------------------------------- evidence / metrics
@register("oil_evidence", "\nUNION ALL\n".join(
    f"SELECT {lag} AS lag_days, count(*) AS required_dates, count(*) FILTER (WHERE oil_lag_{lag} IS NULL) AS missing_values, "
    f"count(*) FILTER (WHERE oil_lag_{lag}_age_days > 0) AS last_known_values, CAST(max(oil_lag_{lag}_age_days) AS BIGINT) AS maximum_source_age_days, "
    f"(SELECT min(date) FROM oil) AS source_date_min, (SELECT max(date) FROM oil) AS source_date_max FROM oil_lookup"
    for lag in S.SAFE_LAGS))
def oil_evidence(c: Ctx) -> DataFrame:
    """A21."""
    dates = c.store_dates.select("date").distinct()
    return P.oil_evidence(FT.oil_lookup(dates, c.oil), c.oil)


@register("transaction_evidence", "\nUNION ALL\n".join(
    f"SELECT {lag} AS lag_days, count(*) AS required_store_dates, "
    f"count(*) FILTER (WHERE transactions_lag_available_count = 0) AS rows_with_no_available_lag, "
    f"count(*) FILTER (WHERE transactions_lag_{lag} IS NULL) AS missing_values FROM txn_lookup"
    for lag in S.SAFE_LAGS))
def transaction_evidence(c: Ctx) -> DataFrame:
    """A22."""
    return P.transaction_evidence(QUERIES["exact_lags_store"](c.spark, c.src.sf_dir))


@register("store_join_evidence", f"""SELECT (SELECT count(*) FROM sales) AS input_rows, count(*) AS output_rows,
  (SELECT count(DISTINCT id) FROM sales) AS input_unique_ids, count(DISTINCT id) AS output_unique_ids,
  (SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM sales s2 LEFT JOIN stores st2 ON s2.store_nbr = st2.store_nbr GROUP BY date, s2.store_nbr, family) WHERE c > 1) AS base_key_duplicate_rows_after_join,
  CAST({O.null_cells(S.STORE_OUTPUT_COLUMNS)} AS BIGINT) AS missing_store_metadata_cells_after_join,
  strftime(min(date), '%Y-%m-%d') AS date_min, strftime(max(date), '%Y-%m-%d') AS date_max
FROM (SELECT s.*, st.city, st.state, st.store_type, st.store_cluster FROM sales s LEFT JOIN stores st ON s.store_nbr = st.store_nbr) sj""")
def store_join_evidence(c: Ctx) -> DataFrame:
    """A23."""
    joined = J.store_join(c.sales, c.stores, validate=False)
    return J.store_join_evidence(c.sales, joined)


# ============================================================================ batch 3: model, sinks, scoring
import json as _json  # noqa: E402

from shelfcast.operators import boosting as B  # noqa: E402
from shelfcast.operators import ridge as RG  # noqa: E402
from shelfcast.operators.ml_stages import fit_preprocessor  # noqa: E402
from shelfcast.plans import model as MD  # noqa: E402
from shelfcast.session import new_output_path  # noqa: E402
from shelfcast.sources import publish as PB  # noqa: E402

_TRAIN_LAGGED_SQL = f"(SELECT * FROM labeled_lagged WHERE date BETWEEN {_MS_SQL} AND {W['train_end']})"


def _model_frames(c: Ctx) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, internal test) of the lagged labeled table, warm-up excluded."""
    lab = c.labeled_lagged
    start = SP.model_start(lab)
    train = lab.filter(F.col("date").between(F.lit(start), F.lit(c.win.train_end)))
    val = SP.date_window(lab, c.win.validation_start, c.win.validation_end)
    test = SP.date_window(lab, c.win.internal_test_start, c.win.internal_test_end)
    return train, val, test


def _future_lagged(c: Ctx) -> DataFrame:
    return FT.add_sales_lags(c.future_features, c.sales)


@register("impute_median", "\nUNION ALL\n".join(
    f"SELECT '{x}' AS column, round(COALESCE(median(CAST({x} AS DOUBLE)), 0), 6) AS median, "
    f"count(*) FILTER (WHERE {x} IS NULL) > 0 AS has_indicator FROM {_TRAIN_LAGGED_SQL}" for x in S.NUMERIC_FEATURES))
def impute_median(c: Ctx) -> DataFrame:
    """M2: fitted training medians and which columns get a missing indicator."""
    from shelfcast.operators.ml_stages import MedianIndicatorImputer

    train, _, _ = _model_frames(c)
    m = MedianIndicatorImputer(inputCols=S.NUMERIC_FEATURES).fit(train)
    ind = set(m.getOrDefault(m.indicatorCols))
    rows = [(col, round(v, 6), col in ind) for col, v in zip(S.NUMERIC_FEATURES, m.getOrDefault(m.medians))]
    return c.spark.createDataFrame(rows, "column string, median double, has_indicator boolean")


def _scale_sql() -> str:
    parts = []
    for x in S.NUMERIC_FEATURES:
        med = f"(SELECT COALESCE(median(CAST({x} AS DOUBLE)), 0) FROM {_TRAIN_LAGGED_SQL})"
        parts.append(f"SELECT '{x}' AS column, round(COALESCE(nullif(stddev_pop(COALESCE(CAST({x} AS DOUBLE), {med})), 0), 1), 6) AS scale FROM {_TRAIN_LAGGED_SQL}")
        parts.append(f"SELECT '{x}__missing' AS column, round(COALESCE(nullif(stddev_pop(CAST({x} IS NULL AS DOUBLE)), 0), 1), 6) AS scale "
                     f"FROM {_TRAIN_LAGGED_SQL} HAVING count(*) FILTER (WHERE {x} IS NULL) > 0")
    return "\nUNION ALL\n".join(parts)


@register("scale_std", _scale_sql())
def scale_std(c: Ctx) -> DataFrame:
    """M3: population-std scales (1 when zero) of imputed numerics and indicators."""
    from shelfcast.operators.ml_stages import MedianIndicatorImputer, PopulationScaler

    train, _, _ = _model_frames(c)
    imp = MedianIndicatorImputer(inputCols=S.NUMERIC_FEATURES).fit(train)
    cols = S.NUMERIC_FEATURES + imp.indicator_names()
    sc = PopulationScaler(inputCols=cols).fit(imp.transform(train))
    rows = [(col, round(v, 6)) for col, v in zip(cols, sc.getOrDefault(sc.scales))]
    return c.spark.createDataFrame(rows, "column string, scale double")


@register("encode_onehot", f"""SELECT v.id,
  CAST((SELECT """ + " + ".join(f"count(DISTINCT {x})" for x in S.CATEGORICAL_FEATURES) + f""" FROM {_TRAIN_LAGGED_SQL})
  + {len(S.NUMERIC_FEATURES)} + (SELECT """ + " + ".join(f"CAST(count(*) FILTER (WHERE {x} IS NULL) > 0 AS INTEGER)" for x in S.NUMERIC_FEATURES)
  + f""" FROM {_TRAIN_LAGGED_SQL}) AS INTEGER) AS width,
  CAST(v.store_nbr IN (SELECT store_nbr FROM {_TRAIN_LAGGED_SQL}) AS INTEGER) AS store_hot
FROM labeled_lagged v WHERE v.date BETWEEN {W['validation_start']} AND {W['validation_end']}""")
def encode_onehot(c: Ctx) -> DataFrame:
    """M1 + M4: one-hot (unseen -> all zeros) and assembled vector width per validation row."""
    from pyspark.ml.functions import vector_to_array

    train, val, _ = _model_frames(c)
    prep, _ = fit_preprocessor(train, S.CATEGORICAL_FEATURES, S.NUMERIC_FEATURES)
    out = prep.transform(val)
    return out.select("id", F.size(vector_to_array("features")).alias("width"),
                      F.size(F.filter(vector_to_array("store_nbr__ohe"), lambda x: x != 0)).alias("store_hot"))


@register("grid_search")
def grid_search(c: Ctx) -> DataFrame:
    """M7 + M8: chronological grid, all 3 ridge and 27 boosted configurations."""
    return _leaderboard(c)


def _training_vectors(c: Ctx) -> tuple[DataFrame, list[str]]:
    """(features, label) of the training window, and the name of each slot."""
    train = MD.with_target(_model_frames(c)[0])
    prep, _ = fit_preprocessor(train, S.CATEGORICAL_FEATURES, S.NUMERIC_FEATURES)
    labels, imputer = prep.stages[0].labelsArray, prep.stages[2]
    names = [f"{x}={v}" for x, values in zip(S.CATEGORICAL_FEATURES, labels) for v in values]
    names += S.NUMERIC_FEATURES + imputer.indicator_names()
    return materialize(prep.transform(train).select("features", "label"), "training-vectors"), names


def _slots_sql(column: str) -> str:
    """(feature, x) of every training row and slot, in SQL: one-hot, imputed numerics (unscaled), indicators."""
    parts = []
    for x in S.CATEGORICAL_FEATURES:
        parts.append(f"SELECT '{x}=' || CAST(v AS VARCHAR) AS feature, CAST(CAST({x} = v AS INTEGER) AS DOUBLE) AS x, {column} "
                     f"FROM t, (SELECT DISTINCT {x} AS v FROM t)")
    for x in S.NUMERIC_FEATURES:
        parts.append(f"SELECT '{x}', COALESCE(CAST({x} AS DOUBLE), (SELECT COALESCE(median(CAST({x} AS DOUBLE)), 0) FROM t)), {column} FROM t")
        parts.append(f"SELECT '{x}__missing', CAST({x} IS NULL AS DOUBLE), {column} FROM t WHERE (SELECT count(*) FROM t WHERE {x} IS NULL) > 0")
    return "\nUNION ALL\n".join(parts)


@register("fit_ridge", f"""SELECT * FROM (WITH t AS (SELECT * FROM {_TRAIN_LAGGED_SQL}), long AS ({_slots_sql("id")})
SELECT feature, count(*) FILTER (WHERE x <> 0) AS nonzero_rows, true AS solved FROM long GROUP BY feature
UNION ALL SELECT 'intercept', count(*), true FROM t)""")
def fit_ridge(c: Ctx) -> DataFrame:
    """M5: ridge (alpha 1.0) fitted on the training window. For each coefficient and the intercept the rows
    it acts on, and whether its normal equation holds, worked out from the rows by plain aggregates
    (to a millionth of the sum of its terms' sizes)."""
    vectors, names = _training_vectors(c)
    fit = RG.fit_ridge(vectors, [1.0])[0]
    named = c.spark.createDataFrame([(-1, "intercept"), *enumerate(names)], "slot int, feature string")
    found = named.join(RG.normal_equations(vectors, fit), "slot", "left")
    return found.select(
        "feature", F.col("rows").alias("nonzero_rows"), (F.abs("residual") <= 1e-6 * F.col("scale")).alias("solved")
    )


_GAIN_SQL = "pow({g} * pow(2.0, -22), 2) / ({n} + 1.0)"


@register("fit_gbt", f"""SELECT * FROM (WITH t AS (SELECT *, ln(1 + CAST(sales AS DOUBLE)) AS label FROM {_TRAIN_LAGGED_SQL}),
base AS (SELECT round(avg(label), 6) AS b FROM t),
long AS ({_slots_sql("label")}),
seen AS (SELECT feature, count(DISTINCT x) AS d, max(x) AS top, quantile_disc(x, [{", ".join(f"{k} / 256.0" for k in range(1, 256))}]) AS q
         FROM long GROUP BY feature),
cuts AS (SELECT DISTINCT feature, x AS cut FROM long JOIN seen USING (feature) WHERE d <= 256 AND x < top
         UNION SELECT feature, cut FROM (SELECT feature, top, unnest(q) AS cut FROM seen WHERE d > 256) WHERE cut < top),
bins AS (SELECT feature, list(cut ORDER BY cut) AS edges FROM cuts GROUP BY feature),
summed AS (SELECT feature, x, count(*) AS n, sum(CAST(round_even((b - label) * 4194304.0, 0) AS HUGEINT)) AS g FROM long, base GROUP BY feature, x),
placed AS (SELECT feature, CAST(len(list_filter(edges, lambda e: e < x)) AS INTEGER) AS bin, len(edges) AS last, n, g
           FROM summed JOIN bins USING (feature)),
histogram AS (SELECT feature, bin, last, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(g) AS BIGINT) AS gradient FROM placed GROUP BY feature, bin, last),
sided AS (SELECT *, CAST(sum(rows) OVER w AS DOUBLE) AS ln, CAST(sum(gradient) OVER w AS DOUBLE) AS lg,
                 CAST(sum(rows) OVER f AS DOUBLE) AS an, CAST(sum(gradient) OVER f AS DOUBLE) AS ag FROM histogram
          WINDOW w AS (PARTITION BY feature ORDER BY bin), f AS (PARTITION BY feature))
SELECT feature, bin, rows, gradient, CASE WHEN bin < last THEN
  round({_GAIN_SQL.format(g="lg", n="ln")} + {_GAIN_SQL.format(g="(ag - lg)", n="(an - ln)")} - {_GAIN_SQL.format(g="ag", n="an")}, 4) END AS gain
FROM sided)""")
def fit_gbt(c: Ctx) -> DataFrame:
    """M6: histogram boosting. The root of the first tree: rows and gradient sum of every bin of every slot
    (in steps of 2**-22), and the gain of a cut after it, L2 penalty 1."""
    vectors, names = _training_vectors(c)
    named = c.spark.createDataFrame([*enumerate(names)], "slot int, feature string")
    return B.root_histogram(vectors).join(named, "slot").select(
        "feature", "bin", "rows", "gradient", F.round("gain", 4).alias("gain")
    )


def _leaderboard(c: Ctx) -> DataFrame:
    """The whole grid's leaderboard, fitted once per context and written."""
    if getattr(c, "_board", None) is None:
        train, val, _ = _model_frames(c)
        c._board = materialize(MD.grid_search(train, val), "leaderboard")
    return c._board


def _selected(c: Ctx) -> tuple[str, dict, dict]:
    """Method, parameters and validation metrics of the selected leaderboard row."""
    row = MD.select_model(_leaderboard(c)).first()
    metrics = {k: row[k] for k in ("run_id", "rmsle", "wape_pct", "signed_bias_pct")}
    return row.method, _json.loads(row.parameters), {"selected_by": "validation rmsle", "validation": metrics}


@register("select_model")
def select_model(c: Ctx) -> DataFrame:
    """L3: best leaderboard row (rmsle, then wape, then run id)."""
    return MD.select_model(_leaderboard(c))


@register("internal_test")
def internal_test(c: Ctx) -> DataFrame:
    """M9: refit the selected configuration on train + validation, score the internal test window once."""
    method, params, evaluation = _selected(c)
    train, val, test = _model_frames(c)
    bundle = MD.fit_bundle(train.unionByName(val), method, params, evaluation)
    metrics = M.forecast_metrics(MD.predictions(bundle["model"], test))
    return metrics.select(
        F.lit(method).alias("method"),
        F.lit(_json.dumps(params, sort_keys=True)).alias("parameters"),
        F.lit(c.win.internal_test_start).alias("start_date"),
        F.lit(c.win.internal_test_end).alias("end_date"),
        "*",
    )


_WIDTH_SQL = " + ".join(
    [f"count(DISTINCT {x})" for x in S.CATEGORICAL_FEATURES] + [f"CAST(count(*) FILTER (WHERE {x} IS NULL) > 0 AS BIGINT)" for x in S.NUMERIC_FEATURES]
) + f" + {len(S.NUMERIC_FEATURES)}"
_SPAN_SQL = (f"SELECT count(*) AS training_rows, CAST(min(date) AS VARCHAR) AS training_start, CAST(max(date) AS VARCHAR) AS training_end, "
             f"CAST({_WIDTH_SQL} AS BIGINT) AS model_slots FROM labeled_lagged WHERE date >= {_MS_SQL} AND date <= {W['internal_test_end']}")


@register("fit_bundle", _SPAN_SQL)
def fit_bundle(c: Ctx) -> DataFrame:
    """Final fit of the selected configuration on every modelled labeled row; exact facts of it: the rows
    it saw, and how many slots the fitted model reads (categories, numerics, missing indicators)."""
    bundle = _final_bundle(c)
    span = bundle["metadata"]["training"]
    row = span["rows"], span["start"], span["end"], bundle["model"].stages[-1].numFeatures
    return c.spark.createDataFrame([row], "training_rows long, training_start string, training_end string, model_slots long")


def _final_bundle(c: Ctx) -> dict:
    """Final fit on every modelled labeled row, once per session context."""
    if getattr(c, "_bundle", None) is None:
        train, val, test = _model_frames(c)
        c._bundle = MD.fit_bundle(train.unionByName(val).unionByName(test), *_selected(c))
    return c._bundle


_SCORED_SQL = "SELECT id, date, store_nbr, family, true AS finite, true AS not_negative FROM future"


def _scored_facts(forecast: DataFrame) -> DataFrame:
    """Keys of a forecast and what holds of every value whichever model gave it."""
    from shelfcast.functions.columns import is_finite

    return forecast.select(
        "id", "date", "store_nbr", "family", is_finite("forecast_sales").alias("finite"),
        (F.col("forecast_sales") >= 0).alias("not_negative"),
    )


@register("score_batch", _SCORED_SQL)
def score_batch(c: Ctx) -> DataFrame:
    """Score the complete 16-day future batch; keys and exact facts of the values."""
    return _scored_facts(MD.score_batch(_final_bundle(c), _future_lagged(c)))


@register("batch_inference", _SCORED_SQL)
def batch_inference(c: Ctx) -> DataFrame:
    """Cutoff, coverage, lags, score, write (to the shared scratch folder)."""
    out = new_output_path(c.spark, "batch_forecast")
    MD.run_batch_inference(_final_bundle(c), c.features, c.future_features, out)
    return _scored_facts(R.read_table(c.spark, out, T_FORECAST, fmt="csv"))


@register("publish_forecast", "SELECT id, date, store_nbr, family, CAST(1.5 * (store_nbr % 7) AS DOUBLE) AS forecast_sales FROM future")
def publish_forecast(c: Ctx) -> DataFrame:
    """A forecast staged, checked and published by manifest, after one that is refused for a negative value
    and one that is too short; read back as readers see it."""
    spark, path = c.spark, new_output_path(c.spark, "published")
    good = c.future.select("id", "date", "store_nbr", "family", (F.col("store_nbr") % 7 * 1.5).cast("double").alias("forecast_sales"))
    R.publish_forecast(good.withColumn("forecast_sales", F.lit(0.0)), path)
    faults = {"negative": good.withColumn("forecast_sales", F.col("forecast_sales") - 1), "short": good.where("store_nbr > 3")}
    expected = c.future.count()
    for fault in faults.values():
        try:
            R.publish_forecast(fault, path, expected)
        except R.ContractError:
            continue
        raise AssertionError("a faulty forecast was published")
    R.publish_forecast(good, path, expected)
    return PB.read_published(spark, path)


@register("history_window_footers", f"SELECT date, store_nbr, family, sales FROM features WHERE date BETWEEN {W['internal_test_end']} - 34 AND {W['internal_test_end']}")
def history_window_footers(c: Ctx) -> DataFrame:
    """The history window of the published feature table; its end date is answered by file footers."""
    path = c.features.inputFiles()[0].rsplit("/", 1)[0]
    return R.history_window_at(c.spark, path, c.win.internal_test_end)


@register("model_roundtrip", """SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS unexpected_rows, CAST(0 AS BIGINT) AS missing_rows,
  CAST(0 AS BIGINT) AS value_mismatches, count(*) AS matching_rows, count(DISTINCT date) AS forecast_dates FROM future""")
def model_roundtrip(c: Ctx) -> DataFrame:
    """Save + load the bundle; parity of scores before and after."""
    bundle = _final_bundle(c)
    fut = _future_lagged(c)
    before = MD.score_batch(bundle, fut, check_window=False)
    path = new_output_path(c.spark, "bundle")
    MD.save_bundle(bundle, path)
    after = MD.score_batch(MD.load_bundle(path), fut, check_window=False)
    return J.forecast_parity(after, before)


from pyspark.sql import types as _T  # noqa: E402

T_FORECAST = _T.StructType([
    _T.StructField("id", _T.LongType()), _T.StructField("date", _T.DateType()),
    _T.StructField("store_nbr", _T.IntegerType()), _T.StructField("family", _T.StringType()),
    _T.StructField("forecast_sales", _T.FloatType()),
])

# ---------------------------------------------------------------------------- sinks / windows / submission
_HIST_SQL = f"SELECT date, store_nbr, family, sales FROM sales WHERE date BETWEEN {W['internal_test_end']} - 34 AND {W['internal_test_end']}"


@register("history_window", _HIST_SQL)
def history_window(c: Ctx) -> DataFrame:
    """Pruned 35-day history ending exactly at the cutoff."""
    return R.history_window(c.sales, c.win.internal_test_end)


@register("compact_history", _HIST_SQL)
def compact_history(c: Ctx) -> DataFrame:
    """Write the sorted gzip CSV history and read it back."""
    path = new_output_path(c.spark, "history")
    R.write_compact_history(c.sales, c.win.internal_test_end, path)
    return R.read_compact_history(c.spark, path)


@register("sink_table", "SELECT * FROM features")
def sink_table(c: Ctx) -> DataFrame:
    """Write the feature table as date-partitioned parquet (refusing overwrite) and read it back."""
    path = new_output_path(c.spark, "features")
    R.write_table(c.features.withColumn("year", F.year("date")), path, partition_by=["year"])
    return c.spark.read.parquet(path).select(*S.LABELED_COLUMNS)


_BASELINE_SQL = (f"SELECT f.id, f.date, f.store_nbr, f.family, CAST(COALESCE(s16.sales, 0) AS FLOAT) AS forecast_sales "
                 f"FROM future f LEFT JOIN sales s16 ON s16.date = f.date - 16 AND s16.store_nbr = f.store_nbr AND s16.family = f.family")


def _baseline_forecast(c: Ctx) -> DataFrame:
    """Seasonal-naive forecast: the exact 16-day sales lag (0 when absent)."""
    lag = FT.add_sales_lags(c.future, c.sales)
    return lag.select("id", "date", "store_nbr", "family",
                      F.coalesce("sales_lag_16", F.lit(0.0)).cast("float").alias("forecast_sales"))


@register("sink_forecast", _BASELINE_SQL)
def sink_forecast(c: Ctx) -> DataFrame:
    """Value rules, then an atomic CSV write; read back."""
    path = new_output_path(c.spark, "forecast")
    R.write_forecast(_baseline_forecast(c), path)
    return R.read_table(c.spark, path, T_FORECAST, fmt="csv")


@register("check_forecast", O.audit_sql(f"({_BASELINE_SQL})", {
    "non_finite_forecast": "forecast_sales IS NULL OR isnan(forecast_sales) OR isinf(forecast_sales)",
    "negative_forecast": "forecast_sales < 0"}, non_empty=True))
def check_forecast(c: Ctx) -> DataFrame:
    """V6."""
    return R.forecast_rules(_baseline_forecast(c))


@register("forecast_summary", f"""SELECT count(*) AS rows, min(date) AS start_date, max(date) AS end_date,
  round(min(CAST(forecast_sales AS DOUBLE)), 6) AS min_forecast,
  round(CAST(sum(CAST(CAST(forecast_sales AS DOUBLE) AS {MONEY_SQL})) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS mean_forecast,
  round(max(CAST(forecast_sales AS DOUBLE)), 6) AS max_forecast FROM ({_BASELINE_SQL})""")
def forecast_summary(c: Ctx) -> DataFrame:
    """A24."""
    return M.forecast_summary(_baseline_forecast(c))


@register("submission", f"SELECT t.id, CAST(b.forecast_sales AS DOUBLE) AS sales FROM template t JOIN ({_BASELINE_SQL}) b ON t.id = b.id")
def submission(c: Ctx) -> DataFrame:
    """Template ids with forecasts (every id must match)."""
    return J.submission(c.src.template(), _baseline_forecast(c))


_PRED_SQL = "sales * CAST(80 + 5 * (store_nbr % 9) AS DOUBLE) / CAST(100 AS DOUBLE)"


@register("forecast_parity", f"""SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS unexpected_rows, CAST(0 AS BIGINT) AS missing_rows,
  CAST(0 AS BIGINT) AS value_mismatches, count(*) AS matching_rows, count(DISTINCT date) AS forecast_dates FROM diagnostics""")
def forecast_parity(c: Ctx) -> DataFrame:
    """The diagnostics forecast vs an independent recomputation from the raw sales table."""
    a = c.diagnostics.select("id", "date", "store_nbr", "family", F.col("predicted_sales").alias("forecast_sales"))
    raw = SP.date_window(c.sales, c.win.internal_test_start, c.win.internal_test_end)
    e = raw.select("id", "date", "store_nbr", "family",
                   (F.col("sales") * (F.lit(80) + F.lit(5) * (F.col("store_nbr") % 9)).cast("double") / F.lit(100.0)).alias("forecast_sales"))
    return J.forecast_parity(a, e)


@register("forecast_parity_dirty", """SELECT (SELECT count(*) FROM diagnostics) AS rows_compared,
  count(*) FILTER (WHERE id % 25 = 1) AS unexpected_rows, count(*) FILTER (WHERE id % 25 IN (1, 2)) AS missing_rows,
  count(*) FILTER (WHERE id % 25 = 3) AS value_mismatches FROM diagnostics""")
def forecast_parity_dirty(c: Ctx) -> DataFrame:
    """J13 on a forecast with rows lost, rows under a wrong id and changed values."""
    k = F.col("id") % 25
    e = c.diagnostics.select("id", "date", "store_nbr", "family", F.col("predicted_sales").alias("forecast_sales"))
    a = e.where(k != 2).withColumns(
        {"forecast_sales": F.when(k == 3, F.col("forecast_sales") + 5).otherwise(F.col("forecast_sales")),
         "id": F.when(k == 1, -1 - F.col("id")).otherwise(F.col("id"))}
    )
    found = J.forecast_parity(a, e)
    return found.select(F.lit(c.diagnostics.count()).alias("rows_compared"), "unexpected_rows", "missing_rows", "value_mismatches")


@register("forecast_metrics", f"""SELECT round(sqrt(avg(pow(ln(1 + greatest(predicted_sales, 0)) - ln(1 + sales), 2))), 6) AS rmsle,
  round(CAST(sum(CAST(abs(greatest(predicted_sales, 0) - sales) AS {MONEY_SQL})) AS DOUBLE) / CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE) * 100.0, 6) AS wape_pct,
  round(CAST(sum(CAST(greatest(predicted_sales, 0) - sales AS {MONEY_SQL})) AS DOUBLE) / CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE) * 100.0, 6) AS signed_bias_pct,
  round(CAST(sum(CAST(greatest(sales - greatest(predicted_sales, 0), 0) AS {MONEY_SQL})) AS DOUBLE) / CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE) * 100.0, 6) AS underforecast_pct,
  round(CAST(sum(CAST(greatest(greatest(predicted_sales, 0) - sales, 0) AS {MONEY_SQL})) AS DOUBLE) / CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE) * 100.0, 6) AS overforecast_pct
FROM diagnostics""")
def forecast_metrics(c: Ctx) -> DataFrame:
    """Rmsle, wape, bias, under / over forecast % (predictions clipped at 0)."""
    return M.forecast_metrics(c.diagnostics)


@register("daily_totals", f"SELECT date, CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE) AS actual_sales, "
                          f"CAST(sum(CAST(predicted_sales AS {MONEY_SQL})) AS DOUBLE) AS predicted_sales FROM diagnostics GROUP BY date")
def daily_totals(c: Ctx) -> DataFrame:
    """A15."""
    return M.daily_totals(c.diagnostics)


_PAIR_ERR_SQL = f"""SELECT family, store_nbr, round(sqrt(avg(pow(ln(1 + predicted_sales) - ln(1 + sales), 2))), 6) AS rmsle,
  round(CAST(sum(CAST(abs(predicted_sales - sales) AS {MONEY_SQL})) AS DOUBLE) / nullif(CAST(sum(CAST(sales AS {MONEY_SQL})) AS DOUBLE), 0) * 100.0, 6) AS wape_pct
FROM diagnostics GROUP BY family, store_nbr"""


@register("best_per_group", f"SELECT family, store_nbr, rmsle, wape_pct FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY rmsle, wape_pct, store_nbr) AS rn FROM ({_PAIR_ERR_SQL})) WHERE rn = 1")
def best_per_group(c: Ctx) -> DataFrame:
    """Per family, the store with the lowest rmsle (then wape, then store)."""
    e = M.error_summary(c.diagnostics, ["family", "store_nbr"]).select("family", "store_nbr", "rmsle", "wape_pct")
    return X.best_per_group(e, ["family"], ["rmsle", "wape_pct", "store_nbr"])


@register("sorted_report", _err_sql(["store_nbr"]) + " ORDER BY absolute_error DESC, store_nbr")
def sorted_report(c: Ctx) -> DataFrame:
    """L1: store error report sorted by absolute error (sort only at the report)."""
    return M.error_summary(c.diagnostics, ["store_nbr"]).orderBy(F.desc("absolute_error"), "store_nbr")


# ============================================================================ batch 4: contracts, joins, holidays, records, requests
from shelfcast.sources import records as REC  # noqa: E402
from shelfcast.streaming import jobs as SJ  # noqa: E402
from shelfcast.streaming import requests as RQ  # noqa: E402

_KEYNULL = O.any_null(S.BASE_KEY)


@register("check_base", O.audit_sql("sales", {"null_base_key": _KEYNULL, "null_id": "id IS NULL", "invalid_date": "date IS NULL"},
                                    {"duplicate_base_key": S.BASE_KEY, "duplicate_id": ["id"]}, non_empty=True))
def check_base(c: Ctx) -> DataFrame:
    """V1 audit of the labeled base."""
    return J.base_rules(c.sales)


_DIRTY_BASE = """(SELECT * REPLACE (CASE WHEN id % 50 = 1 THEN NULL ELSE id END AS id, CASE WHEN id % 50 = 2 THEN NULL ELSE store_nbr END AS store_nbr)
  FROM sales UNION ALL SELECT * FROM sales WHERE id % 50 = 3)"""


def _dirty_base(c: Ctx) -> DataFrame:
    """The base with null ids, null stores and repeated rows."""
    k = F.col("id") % 50
    dirty = c.sales.withColumns({"store_nbr": F.when(k != 2, F.col("store_nbr")), "id": F.when(k != 1, F.col("id"))})
    return dirty.select(*c.sales.columns).unionByName(c.sales.where(k == 3))


@register("check_base_dirty", O.audit_sql(_DIRTY_BASE, {"null_base_key": _KEYNULL, "null_id": "id IS NULL", "invalid_date": "date IS NULL"},
                                          {"duplicate_base_key": S.BASE_KEY, "duplicate_id": ["id"]}, non_empty=True))
def check_base_dirty(c: Ctx) -> DataFrame:
    """V1 audit of a base with faults."""
    return J.base_rules(_dirty_base(c))


_FULL_DIRTY = ("(SELECT o.id AS oid, p.id AS pid, o.sales AS os, p.sales AS ps FROM sales o FULL JOIN (SELECT CASE WHEN id % 40 = 1 THEN -1 - id ELSE id END AS id, "
               "CASE WHEN id % 40 = 2 THEN sales + 1 ELSE sales END AS sales FROM features WHERE id % 40 <> 3) p ON o.id = p.id)")


@register("check_final_dirty", O.audit_sql(_FULL_DIRTY, {
    "lost_rows": "pid IS NULL", "added_rows": "oid IS NULL",
    "target_changed": "oid IS NOT NULL AND pid IS NOT NULL AND os IS DISTINCT FROM ps"}))
def check_final_dirty(c: Ctx) -> DataFrame:
    """V3 audit of a feature table with lost, added and changed rows."""
    k = F.col("id") % 40
    dirty = c.features.where(k != 3).withColumns(
        {"sales": F.when(k == 2, F.col("sales") + 1).otherwise(F.col("sales")), "id": F.when(k == 1, -1 - F.col("id")).otherwise(F.col("id"))}
    )
    return FT.final_rules(dirty, c.sales, has_target=True).where(F.col("rule").isin("lost_rows", "added_rows", "target_changed"))


@register("check_window_dirty", f"""SELECT 'date_outside_window' AS rule, count(*) FILTER (WHERE date = {W['future_end']}) AS violations FROM future_features
UNION ALL SELECT 'missing_known_context', count(*) FILTER (WHERE id % 30 = 1 AND (id % 30 <> 4 OR date = {W['future_end']})) FROM future_features
UNION ALL SELECT 'missing_window_dates', CAST(1 AS BIGINT)""")
def check_window_dirty(c: Ctx) -> DataFrame:
    """V4 audit of a future batch with a shifted day, missing context, wrong weekdays and lost rows."""
    k, last = F.col("id") % 30, F.lit(c.win.future_end)
    dirty = _future_lagged(c).where((k != 4) | (F.col("date") == last)).withColumns(
        {
            "city": F.when(k != 1, F.col("city")),
            "day_of_week": F.when(k == 2, 8).otherwise(F.col("day_of_week")),
            "date": F.when(F.col("date") == last, F.date_add(last, 30)).otherwise(F.col("date")),
        }
    )
    rules = ["date_outside_window", "missing_known_context", "missing_window_dates"]
    return G.window_rules(dirty, c.win.internal_test_end).where(F.col("rule").isin(rules))


@register("check_training_dirty", f"SELECT 'invalid_sales' AS rule, count(*) FILTER (WHERE id % 20 IN (1, 2)) AS violations FROM {_TRAIN_LAGGED_SQL} "
                                  "UNION ALL SELECT 'non_empty', CAST(0 AS BIGINT)")
def check_training_dirty(c: Ctx) -> DataFrame:
    """V5 audit of training rows with null and negative targets."""
    train, _, _ = _model_frames(c)
    k = F.col("id") % 20
    return G.training_rules(train.withColumn("sales", F.when(k == 1, None).when(k == 2, F.lit(-1.0)).otherwise(F.col("sales"))))


def _final_counts_sql(processed: str, ids: str, target: str) -> str:
    expected, other = ([x for x in S.LABELED_COLUMNS if (x in set(S.ALLOWED_MISSING_COLUMNS)) is held] for held in (True, False))
    return f"""SELECT (SELECT count(*) FROM sales) AS input_rows, count(*) AS output_rows, CAST({len(S.LABELED_COLUMNS)} AS BIGINT) AS output_columns,
  CAST({O.null_cells(expected)} AS BIGINT) AS expected_missing_feature_cells, CAST({O.null_cells(other)} AS BIGINT) AS unexpected_missing_cells,
  {O.member_rows(processed, S.BASE_KEY)} AS duplicate_base_key_rows, {ids} AS ids_preserved, {target} AS target_preserved FROM {processed}"""


@register("final_counts", _final_counts_sql(
    "features", "(SELECT list(id ORDER BY id) FROM sales) = list(id ORDER BY id)",
    "(SELECT list(sales ORDER BY id) FROM sales) = list(sales ORDER BY id)"))
def final_counts(c: Ctx) -> DataFrame:
    """V3: the eight counters of the feature table against its base."""
    return FT.final_counts(c.features, c.sales)


_DIRTY_FINAL = ("(SELECT * REPLACE (CASE WHEN id % 9 = 1 THEN NULL ELSE city END AS city, CASE WHEN id % 9 = 2 THEN sales + 1 ELSE sales END AS sales) "
                "FROM features WHERE id % 9 <> 4 UNION ALL SELECT * FROM features WHERE id % 9 = 3)")


@register("final_counts_dirty", _final_counts_sql(_DIRTY_FINAL, "false", "false"))
def final_counts_dirty(c: Ctx) -> DataFrame:
    """V3 counters of a table with lost, repeated and changed rows and missing cities."""
    k = F.col("id") % 9
    dirty = c.features.where(k != 4).withColumns(
        {"city": F.when(k != 1, F.col("city")), "sales": F.when(k == 2, F.col("sales") + 1).otherwise(F.col("sales"))}
    )
    return FT.final_counts(dirty.select(*c.features.columns).unionByName(c.features.where(k == 3)), c.sales)


@register("check_stores", O.audit_sql("stores", {"null_store_nbr": "store_nbr IS NULL",
                                                 "missing_store_metadata": O.any_null(S.STORE_OUTPUT_COLUMNS)},
                                      {"duplicate_store_nbr": ["store_nbr"]}, non_empty=True))
def check_stores(c: Ctx) -> DataFrame:
    """V2 audit of store metadata."""
    return J.store_rules(c.stores)


_FINAL_CHECKED = [x for x in S.LABELED_COLUMNS if x not in set(S.ALLOWED_MISSING_COLUMNS)]
_FULL = "(SELECT o.id AS oid, p.id AS pid, o.sales AS os, p.sales AS ps FROM sales o FULL JOIN features p ON o.id = p.id)"


@register("check_final", O.audit_sql("features", {"unexpected_missing_cells": O.any_null(_FINAL_CHECKED)},
                                     {"duplicate_base_key": S.BASE_KEY}) + "\nUNION ALL\n" + O.audit_sql(_FULL, {
    "lost_rows": "pid IS NULL", "added_rows": "oid IS NULL",
    "target_changed": "oid IS NOT NULL AND pid IS NOT NULL AND os IS DISTINCT FROM ps"}))
def check_final(c: Ctx) -> DataFrame:
    """V3: feature table vs its base (rows, ids, target, allowed nulls, unique key)."""
    return FT.final_rules(c.features, c.sales, has_target=True)


_W0, _W1 = W['future_start'], W['future_end']
_KNOWN = S.CATEGORICAL_FEATURES + ["onpromotion"] + S.HOLIDAY_FEATURE_COLUMNS


@register("check_window", O.audit_sql("future_features", {
    "null_base_key": _KEYNULL, "null_id": "id IS NULL",
    "date_outside_window": f"NOT (date BETWEEN {_W0} AND {_W1})",
    "missing_known_context": O.any_null(_KNOWN),
    "month_mismatch": "month <> month(date)", "day_of_month_mismatch": "day_of_month <> day(date)",
    "day_of_week_mismatch": "day_of_week <> isodow(date)"},
    {"duplicate_base_key": S.BASE_KEY, "duplicate_id": ["id"]}, non_empty=True) + f"""
UNION ALL SELECT 'missing_window_dates', CAST(16 - count(DISTINCT date) FILTER (WHERE date BETWEEN {_W0} AND {_W1}) AS BIGINT) FROM future_features
UNION ALL SELECT 'incomplete_pairs', CAST(count(*) FILTER (WHERE n <> 16) AS BIGINT) FROM (SELECT count(DISTINCT date) AS n FROM future_features GROUP BY store_nbr, family)""")
def check_window(c: Ctx) -> DataFrame:
    """V4: the future batch against the 16-day window after the cutoff."""
    return G.window_rules(_future_lagged(c), c.win.internal_test_end)


@register("check_training", O.audit_sql(_TRAIN_LAGGED_SQL, {"invalid_sales": "sales IS NULL OR sales < 0"}, non_empty=True))
def check_training(c: Ctx) -> DataFrame:
    """V5."""
    train, _, _ = _model_frames(c)
    return G.training_rules(train)


@register("check_cutoff", f"""SELECT 'history_end_differs' AS rule, CAST(CASE WHEN max(date) IS NULL OR max(date) <> {W['internal_test_end']} THEN 1 ELSE 0 END AS BIGINT) AS violations FROM sales
UNION ALL SELECT 'rows_after_cutoff', count(*) FILTER (WHERE date > {W['internal_test_end']}) FROM sales""")
def check_cutoff(c: Ctx) -> DataFrame:
    """V9: history ends exactly at the cutoff."""
    return G.cutoff_rules(c.sales, c.win.internal_test_end)


@register("check_leakage", O.audit_sql("oil_lookup", {"future_oil_match": " OR ".join(f"{x} < 0" for x in S.OIL_AGE_COLUMNS)})
          + "\nUNION ALL\n" + O.audit_sql("future", {"lag_source_after_cutoff": f"date - 16 > {W['internal_test_end']}"})
          + "\nUNION ALL\n" + O.audit_sql(f"({_WINDOW_SQL})", {"window_not_lag_safe": "NOT all_lags_available_by_cutoff"}))
def check_leakage(c: Ctx) -> DataFrame:
    """No as-of match after its reference date, no lag source after the cutoff, lag-safe windows."""
    dates = c.store_dates.select("date").distinct()
    return G.leakage_rules(FT.oil_lookup(dates, c.oil), c.future, c.win.internal_test_end, SP.window_contract(_periods(c)))


@register("attach_m1", "SELECT s.*, " + ", ".join(f"o.{x}" for x in S.OIL_FEATURE_COLUMNS)
          + " FROM sales s LEFT JOIN oil_lookup o ON s.date = o.date")
def attach_m1(c: Ctx) -> DataFrame:
    """Guarded many-to-one attach of the oil lookup (nullable columns declared)."""
    dates = c.store_dates.select("date").distinct()
    return J.attach_m1(c.sales, FT.oil_lookup(dates, c.oil), ["date"], S.OIL_FEATURE_COLUMNS,
                       nullable=S.OIL_FEATURE_COLUMNS, name="oil join", check_required=True)


@register("unmapped_events", """SELECT s.date, s.locale, s.locale_name, s.description FROM scheduled s
WHERE (s.locale = 'Regional' AND s.locale_name NOT IN (SELECT state FROM stores))
   OR (s.locale = 'Local' AND s.locale_name NOT IN (SELECT city FROM stores))""")
def unmapped_events(c: Ctx) -> DataFrame:
    """Scheduled events whose locale reaches no store (anti-joins on state / city)."""
    sched = H.classify_events(c.holidays).filter("is_scheduled")
    reg = J.missing_keys(sched.filter(F.col("locale") == "Regional").withColumn("state", F.col("locale_name")), c.stores, ["state"])
    loc = J.missing_keys(sched.filter(F.col("locale") == "Local").withColumn("city", F.col("locale_name")), c.stores, ["city"])
    cols = ["date", "locale", "locale_name", "description"]
    return reg.select(*cols).unionByName(loc.select(*cols))


@register("missing_store_rows", "SELECT * FROM transactions WHERE store_nbr NOT IN (SELECT store_nbr FROM stores)")
def missing_store_rows(c: Ctx) -> DataFrame:
    """Transaction rows whose store has no metadata (anti-join)."""
    return J.missing_keys(c.transactions, c.stores, ["store_nbr"])


_HP = f"(SELECT DISTINCT store_nbr, family FROM sales WHERE date BETWEEN {W['internal_test_end']} - 34 AND {W['internal_test_end']})"


@register("pair_coverage", f"""SELECT count(*) FILTER (WHERE f.store_nbr IS NULL) AS missing_pairs,
  count(*) FILTER (WHERE h.store_nbr IS NULL) AS unexpected_pairs
FROM {_HP} h FULL JOIN (SELECT DISTINCT store_nbr, family FROM future) f ON h.store_nbr = f.store_nbr AND h.family = f.family""")
def pair_coverage(c: Ctx) -> DataFrame:
    """Future pairs vs the 35-day serving history (idle pairs show as unexpected)."""
    return J.pair_coverage(c.future, R.history_window(c.sales, c.win.internal_test_end))


@register("holiday_attach", f"SELECT id, {', '.join(S.HOLIDAY_FEATURE_COLUMNS)} FROM features")
def holiday_attach(c: Ctx) -> DataFrame:
    """Holiday flags left-joined onto the base by date / state / city, absent -> 0."""
    base = J.store_join(c.sales, c.stores, validate=False)
    return H.attach_holiday_flags(base, c.holidays).select("id", *S.HOLIDAY_FEATURE_COLUMNS)


@register("event_classes", f"""SELECT ntype, CASE WHEN is_planned THEN 'planned_event' WHEN is_earthquake THEN 'earthquake_excluded'
  WHEN ntype = 'event' THEN 'unknown_event' WHEN ntype IN ({', '.join(O._q(t) for t in S.SCHEDULED_TYPES)}) THEN 'scheduled'
  ELSE 'dropped_type' END AS event_class, count(*) AS rows FROM events_classified GROUP BY ALL""")
def event_classes(c: Ctx) -> DataFrame:
    """H2."""
    return H.event_classes(c.holidays)


@register("holiday_evidence", f"""SELECT
  (SELECT count(*) FROM holidays) AS source_calendar_rows,
  (SELECT count(*) FROM events_classified WHERE ntype = 'event') AS source_type_event_rows,
  (SELECT count(*) FROM scheduled) AS scheduled_source_rows,
  (SELECT count(*) FROM events_classified WHERE is_planned) AS planned_type_event_rows,
  (SELECT count(*) FROM events_classified WHERE is_earthquake) AS earthquake_event_rows_excluded,
  (SELECT count(*) FROM events_classified WHERE ntype = 'event' AND NOT is_planned AND NOT is_earthquake) AS unknown_type_event_rows,
  (SELECT count(*) FROM mapped) AS mapped_scheduled_store_rows,
  (SELECT count(*) FROM scheduled s WHERE (s.locale = 'Regional' AND s.locale_name NOT IN (SELECT state FROM stores))
      OR (s.locale = 'Local' AND s.locale_name NOT IN (SELECT city FROM stores))) AS unmapped_scheduled_source_rows,
  (SELECT count(*) FROM holiday_lookup) AS normalized_store_date_rows,
  (SELECT count(*) FROM holidays WHERE transferred) AS source_rows_with_transferred_true,
  (SELECT count(*) - count(DISTINCT (date, store_nbr)) FROM holiday_lookup) AS normalized_duplicate_store_date_rows,
  (SELECT COALESCE(max(n), 0) FROM (SELECT count(*) AS n FROM mapped WHERE NOT transferred GROUP BY date, store_nbr)) AS maximum_active_events_on_one_store_date""")
def holiday_evidence(c: Ctx) -> DataFrame:
    """H3 (+ A19): normalisation counters without expanding national events."""
    return H.holiday_evidence(c.holidays, c.stores)


# ---------------------------------------------------------------------------- JSON records
_REC5 = ["id", "date", "store_nbr", "family", "onpromotion"]


@register("json_records", "SELECT CAST(to_json(struct_pack(" + ", ".join(f"{x} := {x}" for x in _REC5) + ")) AS VARCHAR) AS record FROM future")
def json_records(c: Ctx) -> DataFrame:
    """Future rows as JSON records (ISO dates)."""
    return REC.to_records(c.future, _REC5)


def _records(c: Ctx) -> DataFrame:
    return REC.to_records(c.future_features, S.FUTURE_COLUMNS)


_FLOAT_FIELDS = S.OIL_AGE_COLUMNS + S.TRANSACTION_LAG_COLUMNS
_AS_RECORD = "SELECT * REPLACE (" + ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _FLOAT_FIELDS) + ") FROM future_features"


def _dirty_records(c: Ctx) -> DataFrame:
    """The future batch as JSON, of every 11 ids five with one fault each: wrong type, missing key, extra key,
    value out of range, cut short."""
    rec, k = F.col("record"), F.col("k")
    faults = {
        1: F.regexp_replace(rec, '"oil_lag_16":[^,}]*', '"oil_lag_16":"abc"'),
        2: F.regexp_replace(rec, '"oil_lag_16":[^,}]*,', ""),
        3: F.regexp_replace(rec, r"\}$", ',"sales":1.0}'),
        4: F.regexp_replace(rec, '"day_of_week":[0-9]', '"day_of_week":9'),
        5: F.expr("substring(record, 1, length(record) - 3)"),
    }
    out = rec
    for fault, text in faults.items():
        out = F.when(k == fault, text).otherwise(out)
    rows = c.future_features.select(F.to_json(F.struct(*S.FUTURE_COLUMNS), {"ignoreNullFields": "false"}).alias("record"),
                                    (F.col("id") % 11).alias("k"))
    return rows.select(out.alias("record"))


@register("json_batch_ingest", _AS_RECORD + " WHERE id % 11 NOT IN (1, 2, 3, 4, 5)")
def json_batch_ingest(c: Ctx) -> DataFrame:
    """JSON records parsed with the typed contract; only valid rows returned."""
    valid, _ = REC.parse_records(_dirty_records(c))
    return valid


@register("envelope_ingest", _AS_RECORD + " WHERE store_nbr % 5 NOT IN (1, 2)")
def envelope_ingest(c: Ctx) -> DataFrame:
    """One request body per store; a body with an extra top-level key or without records is rejected whole."""
    bodies = c.future_features.groupBy("store_nbr").agg(
        F.concat_ws(",", F.collect_list(F.to_json(F.struct(*S.FUTURE_COLUMNS), {"ignoreNullFields": "false"}))).alias("rows")
    )
    body = (
        F.when(F.col("store_nbr") % 5 == 1, F.concat(F.lit('{"records":['), "rows", F.lit('],"model":"x"}')))
        .when(F.col("store_nbr") % 5 == 2, F.lit('{"records":[]}'))
        .otherwise(F.concat(F.lit('{"records":['), "rows", F.lit("]}")))
    )
    records, _ = REC.open_envelopes(bodies.select(body.alias("body")), "body")
    valid, _ = REC.parse_records(records)
    return valid


@register("record_rules", """SELECT 'unparseable_record' AS rule, count(*) FILTER (WHERE id % 11 = 5) AS violations FROM future_features
UNION ALL SELECT 'extra_keys', count(*) FILTER (WHERE id % 11 = 3) FROM future_features
UNION ALL SELECT 'missing_or_invalid_field', count(*) FILTER (WHERE id % 11 IN (1, 2)) FROM future_features
UNION ALL SELECT 'out_of_range', count(*) FILTER (WHERE id % 11 = 4) FROM future_features
UNION ALL SELECT 'non_empty', CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) FROM future_features""")
def record_rules(c: Ctx) -> DataFrame:
    """V8: per-record contract over the future batch as JSON, with faults of every kind."""
    return REC.record_rules(_dirty_records(c))


# ---------------------------------------------------------------------------- request log
_OUTCOME_SQL = """CASE WHEN path <> '/forecast' THEN NULL
  WHEN status_code = 422 AND COALESCE(row_count, 0) = 0 THEN 'schema_rejection' WHEN status_code = 422 THEN 'contract_rejection'
  WHEN status_code IN (401, 403) THEN 'authentication_rejection' WHEN status_code = 503 THEN 'service_unavailable'
  WHEN status_code >= 500 THEN 'model_error' WHEN status_code >= 200 AND status_code < 300 THEN 'success' ELSE 'other_response' END"""
_KP = "CASE WHEN path IN ('/health', '/forecast', '/metrics') THEN path ELSE 'other' END"
_AVG = "CAST(sum(CAST(latency_ms AS DECIMAL(28,6))) AS DOUBLE) / CAST(count(*) AS DOUBLE)"


@register("request_outcome", f"SELECT request_id, {_KP} AS known_path, {_OUTCOME_SQL} AS forecast_outcome FROM request_log")
def request_outcome(c: Ctx) -> DataFrame:
    """R2."""
    return RQ.with_outcome(c.src.request_log()).select("request_id", "known_path", "forecast_outcome")


@register("request_rollup", f"SELECT {_KP} AS path, count(*) AS request_count, {_AVG} AS average_ms, max(latency_ms) AS maximum_ms FROM request_log GROUP BY 1")
def request_rollup(c: Ctx) -> DataFrame:
    """Per-path requests and latency."""
    return RQ.path_rollup(c.src.request_log())


@register("status_rollup", "SELECT CAST(status_code AS VARCHAR) AS status, count(*) AS responses FROM request_log GROUP BY 1")
def status_rollup(c: Ctx) -> DataFrame:
    """Responses per status."""
    return RQ.status_rollup(c.src.request_log())


@register("outcome_rollup", f"SELECT {_OUTCOME_SQL} AS forecast_outcome, count(*) AS requests, CAST(sum(row_count) AS BIGINT) AS rows_received "
                            f"FROM request_log WHERE path = '/forecast' GROUP BY 1")
def outcome_rollup(c: Ctx) -> DataFrame:
    """Forecast outcomes and received rows."""
    return RQ.outcome_rollup(c.src.request_log())


_R4 = {"forecast_requests": ("path = '/forecast'", 4), "status_200": ("status_code = 200", 1), "status_422": ("status_code = 422", 2),
       "status_401": ("status_code = 401", 1), "success": (f"({_OUTCOME_SQL}) = 'success'", 1),
       "contract_rejections": (f"({_OUTCOME_SQL}) = 'contract_rejection'", 1), "schema_rejections": (f"({_OUTCOME_SQL}) = 'schema_rejection'", 1),
       "authentication_rejections": (f"({_OUTCOME_SQL}) = 'authentication_rejection'", 1)}


@register("rollup_checks", "\nUNION ALL\n".join(
    [f"SELECT 'min_{k}' AS rule, CAST(CASE WHEN count(*) FILTER (WHERE {cond}) < {v} THEN 1 ELSE 0 END AS BIGINT) AS violations FROM request_log"
     for k, (cond, v) in _R4.items()]
    + ["SELECT 'min_rows_received', CAST(CASE WHEN COALESCE(sum(row_count) FILTER (WHERE path = '/forecast'), 0) < 2 THEN 1 ELSE 0 END AS BIGINT) FROM request_log"]))
def rollup_checks(c: Ctx) -> DataFrame:
    """Post-run counter expectations (0 = met)."""
    return RQ.rollup_checks(c.src.request_log(), successful_batch_rows=1)


@register("request_rollup_stream", f"""SELECT CAST(date_trunc('day', timestamp_utc) AS DATE) AS window_start, {_KP} AS path, count(*) AS request_count,
  {_AVG} AS average_ms, max(latency_ms) AS maximum_ms FROM request_log GROUP BY 1, 2""")
def request_rollup_stream(c: Ctx) -> DataFrame:
    """R1 streaming: events file stream -> daily windows per path (update mode, watermark-bounded state)."""
    out = new_output_path(c.spark, "rollup")
    stream = TD.request_log_from(c.src.events_stream())
    run = SJ.run_rollup_stream(c.spark, stream, out, new_output_path(c.spark, "rollup_ckpt"))
    if run.late:
        raise R.ContractError(f"{run.late} windows got events later than the watermark allows")
    res = SJ.latest_rollup(c.spark, out)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window_start") / 86400).cast("int"))  # UTC day, any session zone
    return res.select(day.alias("window_start"), "path", "request_count", "average_ms", "maximum_ms")


@register("stream_score", _SCORED_SQL)
def stream_score(c: Ctx) -> DataFrame:
    """Complete future batches arriving as JSON Lines files, scored per micro-batch."""
    inp = new_output_path(c.spark, "stream_in")
    recs = _records(c)
    # Two arriving batches: the complete future batch, then the same batch missing its last day.
    recs.write.mode("errorifexists").text(f"{inp}/batch=0")
    last = F.get_json_object("record", "$.date") == F.lit(str(c.win.future_end))
    recs.filter(~last).write.mode("errorifexists").text(f"{inp}/batch=1")
    out, quarantine = new_output_path(c.spark, "stream_out"), new_output_path(c.spark, "stream_quarantine")
    SJ.run_scoring_stream(c.spark, inp, _final_bundle(c), c.sales, out, quarantine, new_output_path(c.spark, "stream_ckpt"))
    return _scored_facts(c.spark.read.parquet(out))


@register("stream_score_pieces", _SCORED_SQL)
def stream_score_pieces(c: Ctx) -> DataFrame:
    """A future batch that arrives in three pieces over three triggers, put together by keyed state and
    scored once, beside a batch that stays without its last piece and is not scored."""
    inp, work = new_output_path(c.spark, "pieces_in"), new_output_path(c.spark, "pieces")
    recs, piece = _records(c), F.get_json_object("record", "$.id").cast("long") % 3
    for k in range(3):
        recs.filter(piece == k).write.mode("append").text(f"{inp}/batch=0")
        if k < 2:
            recs.filter(piece == k).write.mode("append").text(f"{inp}/batch=1")
        SJ.run_piecewise_scoring_stream(c.spark, inp, _final_bundle(c), c.sales, work)
    return _scored_facts(c.spark.read.parquet(f"{work}/out"))
