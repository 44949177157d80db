"""Column contracts and Spark schemas of the forecast tables.

Fixed values: lag days, horizon and column order must equal the contract so
that tables interchange with the original pipeline's processed files.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SAFE_LAGS = [16, 21, 28, 35]
FORECAST_HORIZON_DAYS = 16
HISTORY_DAYS = 35
BASE_KEY = ["date", "store_nbr", "family"]
PAIR_KEY = ["store_nbr", "family"]

TRAIN_COLUMNS = ["id", "date", "store_nbr", "family", "sales", "onpromotion"]
TEST_COLUMNS = ["id", "date", "store_nbr", "family", "onpromotion"]
STORE_COLUMNS = ["store_nbr", "city", "state", "type", "cluster"]
STORE_OUTPUT_COLUMNS = ["city", "state", "store_type", "store_cluster"]
OIL_COLUMNS = ["date", "dcoilwtico"]
TRANSACTION_COLUMNS = ["date", "store_nbr", "transactions"]
HOLIDAY_COLUMNS = ["date", "type", "locale", "locale_name", "description", "transferred"]
CALENDAR_COLUMNS = ["month", "day_of_month", "day_of_week"]

OIL_LAG_COLUMNS = [f"oil_lag_{lag}" for lag in SAFE_LAGS]
OIL_AGE_COLUMNS = [f"oil_lag_{lag}_age_days" for lag in SAFE_LAGS]
OIL_FEATURE_COLUMNS = OIL_LAG_COLUMNS + OIL_AGE_COLUMNS
TRANSACTION_LAG_COLUMNS = [f"transactions_lag_{lag}" for lag in SAFE_LAGS]
TRANSACTION_FEATURE_COLUMNS = TRANSACTION_LAG_COLUMNS + ["transactions_lag_available_count"]
SALES_LAG_COLUMNS = [f"sales_lag_{lag}" for lag in SAFE_LAGS]
SALES_FEATURE_COLUMNS = SALES_LAG_COLUMNS + ["sales_lag_available_count"]
HOLIDAY_FEATURE_COLUMNS = [
    "is_holiday",
    "is_special_work_day",
    "is_holiday_transfer_source",
    "is_holiday_transfer_destination",
    "is_planned_event",
    "is_national_schedule",
    "is_regional_schedule",
    "is_local_schedule",
]
ALLOWED_MISSING_COLUMNS = OIL_FEATURE_COLUMNS + TRANSACTION_LAG_COLUMNS
SALES_NULLABLE_COLUMNS = SALES_LAG_COLUMNS

LABELED_COLUMNS = (
    TRAIN_COLUMNS + STORE_OUTPUT_COLUMNS + CALENDAR_COLUMNS + OIL_FEATURE_COLUMNS
    + TRANSACTION_FEATURE_COLUMNS + HOLIDAY_FEATURE_COLUMNS
)
FUTURE_COLUMNS = [c for c in LABELED_COLUMNS if c != "sales"]
INFERENCE_HISTORY_COLUMNS = BASE_KEY + ["sales"]
FORECAST_COLUMNS = ["id", "date", "store_nbr", "family", "forecast_sales"]

CATEGORICAL_FEATURES = [
    "store_nbr", "family", "city", "state", "store_type", "store_cluster", *CALENDAR_COLUMNS,
]
NUMERIC_FEATURES = (
    ["onpromotion"] + OIL_FEATURE_COLUMNS + TRANSACTION_FEATURE_COLUMNS
    + HOLIDAY_FEATURE_COLUMNS + SALES_LAG_COLUMNS + ["sales_lag_available_count"]
)
MODEL_FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

# Accepted holiday vocabulary (fixed values).
SCHEDULED_TYPES = ["holiday", "additional", "bridge", "transfer", "work_day"]
HOLIDAY_LIKE_TYPES = ["holiday", "additional", "bridge", "transfer"]
PLANNED_EVENT_PATTERN = "dia de la madre|mundial de futbol|black friday|cyber monday"
EARTHQUAKE_TEXT = "terremoto manabi"

# Request-log vocabulary (fixed values).
KNOWN_PATHS = ["/health", "/forecast", "/metrics"]

# --- Spark schemas -----------------------------------------------------------
BASE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("store_nbr", T.IntegerType()),
    T.StructField("family", T.StringType()),
    T.StructField("sales", T.DoubleType()),
    T.StructField("onpromotion", T.LongType()),
])
TEST_SCHEMA = T.StructType([f for f in BASE_SCHEMA.fields if f.name != "sales"])
STORE_SCHEMA = T.StructType([
    T.StructField("store_nbr", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("cluster", T.IntegerType()),
])
OIL_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("dcoilwtico", T.DoubleType()),
])
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("store_nbr", T.IntegerType()),
    T.StructField("transactions", T.IntegerType()),
])
HOLIDAY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("type", T.StringType()),
    T.StructField("locale", T.StringType()),
    T.StructField("locale_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("transferred", T.BooleanType()),
])
TEMPLATE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sales", T.DoubleType()),
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("store_nbr", T.IntegerType()),
    T.StructField("family", T.StringType()),
    T.StructField("sales", T.DoubleType()),
])
REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("row_count", T.LongType()),
])


def _feature_type(name: str) -> T.DataType:
    if name == "id":
        return T.LongType()
    if name == "date":
        return T.DateType()
    if name in ("family", "city", "state", "store_type"):
        return T.StringType()
    if name in ("sales",) or name in OIL_LAG_COLUMNS or name in SALES_LAG_COLUMNS:
        return T.DoubleType()
    if name == "onpromotion":
        return T.LongType()
    return T.IntegerType()


def feature_schema(has_target: bool) -> T.StructType:
    cols = LABELED_COLUMNS if has_target else FUTURE_COLUMNS
    return T.StructType([T.StructField(c, _feature_type(c)) for c in cols])


# The JSON record of one future row: the 33 future columns; ages and transaction lags may be fractions there.
RECORD_SCHEMA = T.StructType([
    T.StructField(f.name, T.DoubleType() if f.name in OIL_AGE_COLUMNS + TRANSACTION_LAG_COLUMNS else f.dataType)
    for f in feature_schema(has_target=False).fields
])
