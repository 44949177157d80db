"""JSON record contract, request-log outcomes and rollups, rolling mean, splits."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import explore as X
from shelfcast.sources import records as REC
from shelfcast.streaming import requests as RQ

D = dt.date


def _records(spark, future_df):
    return REC.to_records(future_df.select(*S.FUTURE_COLUMNS))


def test_valid_records_parse_to_contract(spark, future_df):
    valid, rejected = REC.parse_records(_records(spark, future_df))
    assert valid.count() == 32 and rejected.count() == 0
    assert valid.columns == S.FUTURE_COLUMNS


def test_extra_key_and_missing_field_are_rejected(spark, future_df):
    recs = _records(spark, future_df)
    first = json.loads(recs.first().record)
    extra = dict(first, sales=1.0)
    missing = {k: v for k, v in first.items() if k != "city"}
    bad_range = dict(first, month=13)
    df = spark.createDataFrame([(json.dumps(x),) for x in (extra, missing, bad_range)], "record string")
    valid, rejected = REC.parse_records(df)
    assert valid.count() == 0
    reasons = sorted(tuple(r.reasons) for r in rejected.collect())
    assert ("extra_keys",) in reasons and ("missing_or_invalid_field",) in reasons and ("out_of_range",) in reasons


def test_envelope_request(spark, future_df, tmp_path):
    recs = [json.loads(r.record) for r in _records(spark, future_df).collect()]
    p = tmp_path / "req.json"
    p.write_text(json.dumps({"records": recs}))
    assert REC.read_envelope(spark, str(p)).count() == 32


def _log(spark, rows):
    return spark.createDataFrame(
        [("http_request", None, str(i), "POST", path, status, lat, n) for i, (path, status, lat, n) in enumerate(rows)],
        "event string, timestamp_utc timestamp, request_id string, method string, path string, status_code int, latency_ms double, row_count long",
    )


def test_request_outcomes_and_rollups(spark):
    log = _log(spark, [
        ("/forecast", 200, 10.0, 32), ("/forecast", 422, 5.0, 0), ("/forecast", 422, 6.0, 1),
        ("/forecast", 401, 1.0, 0), ("/health", 200, 1.0, 0), ("/nope", 404, 2.0, 0),
    ])
    out = {r.request_id: r.forecast_outcome for r in RQ.with_outcome(log).collect()}
    assert out == {"0": "success", "1": "schema_rejection", "2": "contract_rejection",
                   "3": "authentication_rejection", "4": None, "5": None}
    paths = {r.path: r for r in RQ.path_rollup(log).collect()}
    assert paths["/forecast"].request_count == 4 and paths["/forecast"].maximum_ms == 10.0
    assert paths["/forecast"].average_ms == pytest.approx(5.5)
    assert "other" in paths
    checks = {r.rule: r.violations for r in RQ.rollup_checks(log, successful_batch_rows=32).collect()}
    assert all(v == 0 for v in checks.values()), checks


def test_rolling_mean_matches_pandas(spark):
    days = [D(2020, 1, 1) + dt.timedelta(days=k) for k in range(80) if k % 7 not in (3, 4)]
    vals = [float((k * 37) % 101) for k in range(len(days))]
    daily = spark.createDataFrame(list(zip(days, vals)), "date date, daily_sales double")
    got = X.rolling_mean(daily).toPandas().set_index("date").sort_index()["rolling_28d_mean"]
    s = pd.Series(vals, index=pd.to_datetime(days)).rolling("28D", min_periods=7).mean()
    for d, v in zip(days, s.values):
        g = got.loc[d]
        assert (pd.isna(v) and pd.isna(g)) or g == pytest.approx(v, rel=1e-12)


def test_lag_safety_future_features_ignore_post_cutoff_history(spark):
    from shelfcast.plans.features import add_sales_lags

    cutoff = D(2017, 8, 15)
    target = spark.createDataFrame([(1, cutoff + dt.timedelta(days=k), 1, "A") for k in range(1, 17)],
                                   "id long, date date, store_nbr int, family string")
    hist = spark.createDataFrame([(cutoff - dt.timedelta(days=k), 1, "A", float(k)) for k in range(0, 60)], S.HISTORY_SCHEMA)
    later = spark.createDataFrame([(cutoff + dt.timedelta(days=k), 1, "A", 1e6) for k in range(1, 30)], S.HISTORY_SCHEMA)
    a = sorted(add_sales_lags(target, hist).collect())
    b = sorted(add_sales_lags(target, hist.unionByName(later)).collect())
    assert a == b
