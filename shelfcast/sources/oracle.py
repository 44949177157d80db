"""The derived store-sales tables of ``testdata.py`` written as DuckDB SQL.

``PRELUDE`` is a ``WITH`` list over the driver's pre-registered views; every
oracle query in ``__spark_entry__`` is ``PRELUDE + <select>``. Definitions
mirror the Spark ones exactly (same casts, same decimal sums).
"""

from __future__ import annotations

from shelfcast import schemas as S
from shelfcast.sources import testdata as TD


N = TD.WINDOW_DAYS
#: The bounds of the evaluation windows as scalar subqueries.
W = {
    name: f"(SELECT {name} FROM win)"
    for name in (
        "train_end", "validation_start", "validation_end", "internal_test_start", "internal_test_end",
        "future_start", "future_end",
    )
}


def _id(row: str) -> str:
    day = f"CAST(date_diff('day', DATE '{TD.ID_EPOCH}', {row}.date) AS BIGINT)"
    return (
        f"({day} * (SELECT stores FROM id_sizes) + {row}.store_nbr) * (SELECT families FROM id_sizes) + f.family_rank"
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rules_values() -> str:
    rows = [
        f"({m}, {d}, {_q(t)}, {_q(loc)}, {_q(ln)}, {_q(desc)}, {'true' if tr else 'false'})"
        for (m, d, t, loc, ln, desc, tr) in TD.CALENDAR_RULES
    ]
    return ",\n    ".join(rows)


def _path_case() -> str:
    whens = " ".join(f"WHEN event_type = {_q(k)} THEN {_q(v)}" for k, v in TD.EVENT_PATHS.items())
    return f"CASE {whens} ELSE '/admin' END"


def _lags(prefix: str, src: str, keys: list[str], value: str, base: str) -> tuple[str, str]:
    """SELECT list + LEFT JOINs for exact lags of ``src.value`` onto alias ``base``."""
    sel, joins = [], []
    for lag in S.SAFE_LAGS:
        a = f"{prefix[0]}{lag}"
        on = " AND ".join([f"{a}.date = {base}.date - {lag}"] + [f"{a}.{k} = {base}.{k}" for k in keys])
        joins.append(f"LEFT JOIN {src} {a} ON {on}")
        sel.append(f"{a}.{value} AS {prefix}_lag_{lag}")
    cnt = " + ".join(f"CAST({prefix[0]}{lag}.{value} IS NOT NULL AS INTEGER)" for lag in S.SAFE_LAGS)
    sel.append(f"CAST({cnt} AS INTEGER) AS {prefix}_lag_available_count")
    return ",\n    ".join(sel), "\n  ".join(joins)


def _oil_asof() -> str:
    sel, joins = [], []
    for lag in S.SAFE_LAGS:
        a = f"o{lag}"
        joins.append(f"ASOF LEFT JOIN oil_obs {a} ON r.ref_{lag} >= {a}.src")
        sel.append(f"{a}.v AS oil_lag_{lag}")
    for lag in S.SAFE_LAGS:
        sel.append(f"CAST(date_diff('day', o{lag}.src, r.ref_{lag}) AS INTEGER) AS oil_lag_{lag}_age_days")
    refs = ", ".join(f"date - {lag} AS ref_{lag}" for lag in S.SAFE_LAGS)
    return (
        f"oil_lookup AS (\n  SELECT r.date,\n    " + ",\n    ".join(sel)
        + f"\n  FROM (SELECT date, {refs} FROM req_dates) r\n  " + "\n  ".join(joins) + "\n)"
    )


def _holiday_flags_sql() -> str:
    like = ", ".join(_q(t) for t in S.HOLIDAY_LIKE_TYPES)
    flags = {
        "is_holiday": f"NOT transferred AND ntype IN ({like})",
        "is_special_work_day": "NOT transferred AND ntype = 'work_day'",
        "is_holiday_transfer_source": "ntype = 'holiday' AND transferred",
        "is_holiday_transfer_destination": "NOT transferred AND ntype = 'transfer'",
        "is_planned_event": "NOT transferred AND ntype = 'event'",
        "is_national_schedule": "NOT transferred AND locale = 'National'",
        "is_regional_schedule": "NOT transferred AND locale = 'Regional'",
        "is_local_schedule": "NOT transferred AND locale = 'Local'",
    }
    return ",\n    ".join(
        f"CAST(max(CASE WHEN {c} THEN 1 ELSE 0 END) AS INTEGER) AS {n}" for n, c in flags.items()
    )


def prelude() -> str:
    sched = ", ".join(_q(t) for t in S.SCHEDULED_TYPES)
    txn_sel, txn_join = _lags("transactions", "transactions", ["store_nbr"], "transactions", "sd")
    sal_sel, sal_join = _lags("sales", "sales", ["store_nbr", "family"], "sales", "f")
    hflags = _holiday_flags_sql()
    hcols = ",\n    ".join(f"CAST(COALESCE(h.{c}, 0) AS INTEGER) AS {c}" for c in S.HOLIDAY_FEATURE_COLUMNS)
    return f"""WITH
win AS (
  SELECT mx - {3 * N} AS train_end, mx - {3 * N - 1} AS validation_start, mx - {2 * N} AS validation_end,
         mx - {2 * N - 1} AS internal_test_start, mx - {N} AS internal_test_end, mx - {N - 1} AS future_start, mx AS future_end
  FROM (SELECT max(CAST(l_shipdate AS DATE)) AS mx FROM lineitem)
),
id_sizes AS (
  SELECT (SELECT max(n_nationkey) + 2 FROM nation) AS stores, (SELECT count(DISTINCT p_type) FROM part) AS families
),
stores_raw AS (
  SELECT CAST(n_nationkey + 1 AS INTEGER) AS store_nbr, n_name AS city, r_name AS state,
         chr(CAST(65 + n_nationkey % 5 AS INTEGER)) AS type, CAST(n_regionkey + 1 AS INTEGER) AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
stores AS (SELECT store_nbr, city, state, type AS store_type, cluster AS store_cluster FROM stores_raw),
families AS (
  SELECT family, CAST(row_number() OVER (ORDER BY family) - 1 AS INTEGER) AS family_rank
  FROM (SELECT DISTINCT p_type AS family FROM part)
),
sales_all AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey + 1 AS INTEGER) AS store_nbr, p_type AS family,
         CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sales,
         CAST(SUM(CASE WHEN l_discount >= CAST({TD.PROMO_DISCOUNT} AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS onpromotion
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3
),
sales AS (
  SELECT {_id('s')} AS id,
         s.date, s.store_nbr, s.family, s.sales, s.onpromotion
  FROM sales_all s JOIN families f ON s.family = f.family
  WHERE s.date <= {W['internal_test_end']}
),
pairs AS (SELECT DISTINCT store_nbr, family FROM sales_all WHERE date < {W['future_start']}),
future_grid AS (
  SELECT p.store_nbr, p.family, CAST(g.d AS DATE) AS date
  FROM pairs p CROSS JOIN (SELECT unnest(generate_series({W['future_start']}, {W['future_end']}, INTERVAL 1 DAY)) AS d) g
),
future AS (
  SELECT {_id('g')} AS id,
         g.date, g.store_nbr, g.family, COALESCE(s.onpromotion, CAST(0 AS BIGINT)) AS onpromotion
  FROM future_grid g JOIN families f ON g.family = f.family
  LEFT JOIN sales_all s ON s.date = g.date AND s.store_nbr = g.store_nbr AND s.family = g.family
),
template AS (SELECT id, CAST(0 AS DOUBLE) AS sales FROM future),
oil AS (
  SELECT CAST(o_orderdate AS DATE) - CAST(greatest(isodow(CAST(o_orderdate AS DATE)) - 5, 0) AS INTEGER) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS dcoilwtico
  FROM orders GROUP BY 1
),
transactions AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey + 1 AS INTEGER) AS store_nbr, CAST(COUNT(*) AS INTEGER) AS transactions
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
),
years AS (
  SELECT CAST(unnest(range((SELECT min(year(l_shipdate)) FROM lineitem), (SELECT max(year(l_shipdate)) FROM lineitem) + 1)) AS INTEGER) AS year
),
calendar_rules AS (
  SELECT * FROM (VALUES
    {_rules_values()}
  ) AS t(month, day, type, locale, locale_name, description, transferred)
),
holidays AS (
  SELECT make_date(y.year, r.month, r.day) AS date, r.type, r.locale, r.locale_name, r.description, r.transferred
  FROM calendar_rules r CROSS JOIN years y
  UNION ALL
  SELECT make_date(y.year, CAST(1 + r_regionkey * 2 AS INTEGER), 12), 'Holiday', 'Regional', r_name,
         'Provincializacion de ' || r_name, false
  FROM region CROSS JOIN years y
  UNION ALL
  SELECT make_date(y.year, CAST(1 + n_nationkey % 12 AS INTEGER), CAST(1 + n_nationkey AS INTEGER)), 'Holiday', 'Local', n_name,
         'Fundacion de ' || n_name, false
  FROM nation CROSS JOIN years y
),
events_classified AS (
  SELECT *,
    ntype = 'event' AND regexp_matches(ndesc, {_q(S.PLANNED_EVENT_PATTERN)}) AS is_planned,
    ntype = 'event' AND contains(ndesc, {_q(S.EARTHQUAKE_TEXT)}) AS is_earthquake
  FROM (SELECT *, replace(lower(type), ' ', '_') AS ntype, lower(description) AS ndesc FROM holidays)
),
scheduled AS (SELECT * FROM events_classified WHERE ntype IN ({sched}) OR is_planned),
mapped AS (
  SELECT s.*, st.store_nbr FROM scheduled s JOIN stores st
    ON s.locale = 'National' OR (s.locale = 'Regional' AND s.locale_name = st.state)
       OR (s.locale = 'Local' AND s.locale_name = st.city)
),
holiday_lookup AS (
  SELECT date, store_nbr,
    {hflags}
  FROM mapped GROUP BY date, store_nbr
),
base_all AS (
  SELECT id, date, store_nbr, family, sales, onpromotion, true AS labeled FROM sales
  UNION ALL
  SELECT id, date, store_nbr, family, CAST(NULL AS DOUBLE), onpromotion, false FROM future
),
req_dates AS (SELECT DISTINCT date FROM base_all),
oil_obs AS (SELECT date AS src, dcoilwtico AS v FROM oil WHERE dcoilwtico IS NOT NULL),
{_oil_asof()},
store_dates AS (SELECT DISTINCT date, store_nbr FROM base_all),
txn_lookup AS (
  SELECT sd.date, sd.store_nbr,
    {txn_sel}
  FROM store_dates sd
  {txn_join}
),
features_all AS (
  SELECT b.id, b.date, b.store_nbr, b.family, b.sales, b.onpromotion, b.labeled,
    st.city, st.state, st.store_type, st.store_cluster,
    CAST(month(b.date) AS INTEGER) AS month, CAST(day(b.date) AS INTEGER) AS day_of_month,
    CAST(isodow(b.date) AS INTEGER) AS day_of_week,
    o.oil_lag_16, o.oil_lag_21, o.oil_lag_28, o.oil_lag_35,
    o.oil_lag_16_age_days, o.oil_lag_21_age_days, o.oil_lag_28_age_days, o.oil_lag_35_age_days,
    t.transactions_lag_16, t.transactions_lag_21, t.transactions_lag_28, t.transactions_lag_35,
    t.transactions_lag_available_count,
    {hcols}
  FROM base_all b JOIN stores st ON b.store_nbr = st.store_nbr
  LEFT JOIN oil_lookup o ON o.date = b.date
  LEFT JOIN txn_lookup t ON t.date = b.date AND t.store_nbr = b.store_nbr
  LEFT JOIN holiday_lookup h ON h.date = b.date AND h.store_nbr = b.store_nbr
),
features AS (SELECT {", ".join(S.LABELED_COLUMNS)} FROM features_all WHERE labeled),
future_features AS (SELECT {", ".join(S.FUTURE_COLUMNS)} FROM features_all WHERE NOT labeled),
labeled_lagged AS (
  SELECT f.*,
    {sal_sel}
  FROM features f
  {sal_join}
),
diag_base AS (
  SELECT *, sales * CAST(80 + 5 * (store_nbr % 9) AS DOUBLE) / CAST(100 AS DOUBLE) AS predicted_sales
  FROM features WHERE date BETWEEN {W['internal_test_start']} AND {W['internal_test_end']}
),
diagnostics AS (
  SELECT *, CAST(date_diff('day', (SELECT min(date) FROM diag_base), date) + 1 AS INTEGER) AS forecast_day,
    CASE WHEN onpromotion > 0 THEN 'Promotion' ELSE 'No promotion' END AS promotion_segment,
    CASE WHEN is_holiday = 1 THEN 'Holiday' ELSE 'Non-holiday' END AS holiday_segment,
    day_of_week IN (6, 7) AS is_weekend_group
  FROM diag_base
),
forecast_eval AS (
  SELECT *, sales * CAST(80 + 5 * (store_nbr % 9) AS DOUBLE) / CAST(100 AS DOUBLE) AS predicted_sales
  FROM sales WHERE date BETWEEN {W['internal_test_start']} AND {W['internal_test_end']}
),
request_log AS (
  SELECT 'http_request' AS event, ts AS timestamp_utc, CAST(event_id AS VARCHAR) AS request_id,
         CASE WHEN path = '/forecast' THEN 'POST' ELSE 'GET' END AS method, path, status_code,
         value AS latency_ms,
         CAST(CASE WHEN path = '/forecast' AND status_code = 200 THEN (k % 3 + 1) * 16
                   WHEN path = '/forecast' AND status_code <> 401 THEN (k % 3) * 16 ELSE 0 END AS BIGINT) AS row_count
  FROM (
    SELECT *, {_path_case()} AS path,
      CASE WHEN k % 10 <= 5 THEN 200 WHEN k % 10 = 6 THEN 422 WHEN k % 10 = 7 THEN 401
           WHEN k % 10 = 8 THEN 503 ELSE 500 END AS status_code
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  )
)
"""


PRELUDE = prelude()


def sql(body: str) -> str:
    return PRELUDE + body


def audit_sql(table: str, rules: dict[str, str] | None = None, unique: dict[str, list[str]] | None = None,
              non_empty: bool = False) -> str:
    """(rule, violations) rows: the SQL twin of ``contracts.audit``."""
    parts = []
    for name, pred in (rules or {}).items():
        parts.append(f"SELECT '{name}' AS rule, CAST(count(*) FILTER (WHERE {pred}) AS BIGINT) AS violations FROM {table}")
    if non_empty:
        parts.append(f"SELECT 'non_empty' AS rule, CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM {table}")
    for name, keys in (unique or {}).items():
        k = ", ".join(keys)
        parts.append(
            f"SELECT '{name}' AS rule, CAST(COALESCE(sum(c - 1), 0) AS BIGINT) AS violations "
            f"FROM (SELECT count(*) AS c FROM {table} GROUP BY {k}) WHERE c > 1"
        )
    return "\nUNION ALL\n".join(parts)


def any_null(cols: list[str]) -> str:
    return " OR ".join(f"{c} IS NULL" for c in cols)


def null_cells(cols: list[str]) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)


def member_rows(table: str, keys: list[str]) -> str:
    return (f"(SELECT CAST(COALESCE(sum(c), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {table} "
            f"GROUP BY {', '.join(keys)}) WHERE c > 1)")


def extra_rows(table: str, keys: list[str]) -> str:
    return (f"(SELECT CAST(COALESCE(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {table} "
            f"GROUP BY {', '.join(keys)}) WHERE c > 1)")
