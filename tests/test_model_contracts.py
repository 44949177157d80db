"""Sales lags, forecast-window rules, scoring guards, history window and sinks."""

import datetime as dt
import math

import numpy as np
import pyspark
import pytest
from pyspark.ml import Transformer
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import guards as G
from shelfcast.operators.contracts import ContractError
from shelfcast.operators.metrics import error_summary, forecast_metrics
from shelfcast.plans import features as FT
from shelfcast.plans import model as MD
from shelfcast.session import new_output_path
from shelfcast.sources import readers as R

D = dt.date
CUTOFF = D(2017, 8, 15)


def _history(spark, drop=None):
    rows = []
    for store, fam, base in [(1, "GROCERY I", 100), (2, "BEVERAGES", 200)]:
        for i, lag in enumerate(S.SAFE_LAGS, start=1):
            d = CUTOFF + dt.timedelta(days=1) - dt.timedelta(days=lag)
            if drop == (store, lag):
                continue
            rows.append((d, store, fam, float(base + i)))
    return spark.createDataFrame(rows, S.HISTORY_SCHEMA)


def _target(spark):
    return spark.createDataFrame(
        [(1, CUTOFF + dt.timedelta(days=1), 1, "GROCERY I"), (2, CUTOFF + dt.timedelta(days=1), 2, "BEVERAGES")],
        "id long, date date, store_nbr int, family string",
    )


def test_sales_lags_by_pair(spark):
    out = {r.store_nbr: r for r in FT.add_sales_lags(_target(spark), _history(spark)).collect()}
    assert [out[1][c] for c in S.SALES_LAG_COLUMNS] == [101.0, 102.0, 103.0, 104.0]
    assert [out[2][c] for c in S.SALES_LAG_COLUMNS] == [201.0, 202.0, 203.0, 204.0]
    assert out[1].sales_lag_available_count == 4


def test_missing_sales_history_stays_missing(spark):
    out = {r.store_nbr: r for r in FT.add_sales_lags(_target(spark), _history(spark, drop=(1, 21))).collect()}
    assert out[1].sales_lag_21 is None and out[1].sales_lag_available_count == 3
    assert out[2].sales_lag_available_count == 4


def _violations(df):
    return {r.rule: r.violations for r in G.window_rules(df, CUTOFF).collect() if r.violations}


def test_valid_window_passes(future_df):
    assert _violations(future_df) == {}


@pytest.mark.parametrize(
    "mutate, rule",
    [
        (lambda df: df.filter(F.col("date") != F.lit(D(2017, 8, 31))), "missing_window_dates"),
        (lambda df: df.withColumn("date", F.date_add("date", 1)), "date_outside_window"),
        (lambda df: df.unionByName(df.limit(1).withColumn("id", F.lit(999).cast("long"))), "duplicate_base_key"),
        (lambda df: df.withColumn("id", F.when(F.col("id") == 2, 1).otherwise(F.col("id")).cast("long")), "duplicate_id"),
        (lambda df: df.filter(F.col("id") != 5), "incomplete_pairs"),
        (lambda df: df.withColumn("day_of_week", (F.col("day_of_week") % 7) + 1), "day_of_week_mismatch"),
        (lambda df: df.withColumn("city", F.when(F.col("id") == 3, None).otherwise(F.col("city"))), "missing_known_context"),
        (lambda df: df.withColumn("month", F.lit(1)), "month_mismatch"),
    ],
)
def test_window_violations(future_df, mutate, rule):
    assert rule in _violations(mutate(future_df))


def test_window_rejects_sales_and_missing_feature(future_df):
    with pytest.raises(ContractError, match="sales"):
        G.window_rules(future_df.withColumn("sales", F.lit(1.0)), CUTOFF)
    with pytest.raises(ContractError, match="missing columns"):
        G.window_rules(future_df.drop("oil_lag_16"), CUTOFF)


def test_pair_coverage_missing_and_extra(spark, future_df):
    from shelfcast.operators.joins import pair_coverage

    hist = _history(spark)
    assert pair_coverage(future_df, hist).first().asDict() == {"missing_pairs": 0, "unexpected_pairs": 0}
    extra = hist.unionByName(hist.limit(1).withColumn("family", F.lit("DAIRY")))
    assert pair_coverage(future_df, extra).first().missing_pairs == 1
    assert pair_coverage(future_df.filter(F.col("store_nbr") == 1), hist).first().missing_pairs == 1


class _Const(Transformer):
    def __init__(self, value):
        super().__init__()
        self.value = value

    def _transform(self, df):
        return df.withColumn("prediction", F.lit(self.value))


def _bundle(value):
    metadata = {
        "model_version": MD.MODEL_VERSION, "horizon_days": S.FORECAST_HORIZON_DAYS, "lag_days": list(S.SAFE_LAGS),
        "features": {"ordered": list(S.MODEL_FEATURES)}, "training": {"end": CUTOFF.isoformat()},
        "evaluation": {"selected_by": "validation rmsle"}, "engine": {"spark": pyspark.__version__},
    }
    return {"artifact_schema_version": 1, "metadata": metadata, "model": _Const(value)}


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"artifact_schema_version": 2}, "schema_version"), ({"extra": 1}, "top_level_keys"), ({"model": 3}, "model_transforms"),
        ({"model_version": "x"}, "model_version"), ({"horizon_days": 7}, "horizon_days"), ({"engine": {"spark": "1"}}, "spark_version"),
        ({"features": {"ordered": S.MODEL_FEATURES[::-1]}}, "feature_order"), ({"evaluation": {}}, "evaluation"), ({"training": {}}, "training_end"),
    ],
)
def test_bundle_rules_name_what_is_broken(future_df, change, rule):
    bundle = _bundle(1.0)
    top = {k: v for k, v in change.items() if k in ("artifact_schema_version", "extra", "model")}
    bundle = {**bundle, **top, "metadata": {**bundle["metadata"], **{k: v for k, v in change.items() if k not in top}}}
    with pytest.raises(ContractError, match=rule):
        MD.score_batch(bundle, future_df)


def test_null_prediction_is_not_zero(future_df):
    with pytest.raises(ContractError, match="not finite"):
        MD.score_batch(_bundle(None), future_df)


def test_constant_model_scores_every_row_deterministically(future_df):
    out = MD.score_batch(_bundle(math.log1p(25.0)), future_df)
    vals = [r.forecast_sales for r in out.collect()]
    assert len(vals) == 32 and all(abs(v - 25.0) < 1e-4 for v in vals)
    again = [r.forecast_sales for r in MD.score_batch(_bundle(math.log1p(25.0)), future_df).collect()]
    assert sorted(vals) == sorted(again)


def test_nan_predictions_raise(future_df):
    with pytest.raises(ContractError, match="not finite"):
        MD.score_batch(_bundle(float("nan")), future_df)


def test_forecast_sink_rejects_bad_values(spark):
    def fc(v):
        return spark.createDataFrame([(1, D(2017, 8, 16), 1, "GROCERY I", v)], "id long, date date, store_nbr int, family string, forecast_sales double")

    for bad in (float("inf"), -1.0):
        with pytest.raises(ValueError):
            R.write_forecast(fc(bad), new_output_path(spark, "bad_forecast"))
    path = R.write_forecast(fc(3.5), new_output_path(spark, "good_forecast"))
    with pytest.raises(FileExistsError):
        R.write_forecast(fc(3.5), path)


def _long_history(spark, end=CUTOFF, days=60):
    rows = [(end - dt.timedelta(days=k), s, "GROCERY I", float(k + s)) for k in range(days) for s in (1, 2)]
    return spark.createDataFrame(rows, S.HISTORY_SCHEMA)


def test_history_window_prunes_and_checks_cutoff(spark):
    h = _long_history(spark)
    w = R.history_window(h, CUTOFF)
    assert w.columns == S.INFERENCE_HISTORY_COLUMNS
    agg = w.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert agg[0] == CUTOFF - dt.timedelta(days=34) and agg[1] == CUTOFF and agg[2] == 70
    later = h.unionByName(spark.createDataFrame([(CUTOFF + dt.timedelta(days=1), 1, "GROCERY I", 1.0)], S.HISTORY_SCHEMA))
    with pytest.raises(ContractError):
        R.history_window(later, CUTOFF)


def test_compact_history_roundtrip(spark):
    h = _long_history(spark)
    path = R.write_compact_history(h, CUTOFF, new_output_path(spark, "hist"))
    back = R.read_compact_history(spark, path)
    exp = R.history_window(h, CUTOFF)
    assert sorted(back.collect()) == sorted(exp.collect())


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.uniform(0, 50, 200), 4)
    p = np.round(rng.uniform(-5, 60, 200), 4)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, p)], "sales double, predicted_sales double")
    m = forecast_metrics(df).first()
    pc = np.clip(p, 0, None)
    den = a.sum()
    assert m.rmsle == pytest.approx(np.sqrt(np.mean((np.log1p(pc) - np.log1p(a)) ** 2)), abs=1e-6)
    assert m.wape_pct == pytest.approx(np.abs(pc - a).sum() / den * 100, abs=1e-6)
    assert m.signed_bias_pct == pytest.approx((pc - a).sum() / den * 100, abs=1e-6)
    assert m.underforecast_pct == pytest.approx(np.maximum(a - pc, 0).sum() / den * 100, abs=1e-6)


def test_zero_actual_total_raises_but_segment_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0, "x")], "sales double, predicted_sales double, seg string")
    with pytest.raises(Exception, match="positive"):
        forecast_metrics(df).collect()
    row = error_summary(df, ["seg"]).first()
    assert row.wape_pct is None and row.error_contribution_pct == 100.0


def test_strict_csv_scan(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("id,date,store_nbr,family,sales,onpromotion\n1,2017-01-01,1,GROCERY I,5.5,0\n")
    df = R.read_table(spark, str(good), S.BASE_SCHEMA, fmt="csv")
    row = df.first()
    assert row.date == D(2017, 1, 1) and row.sales == 5.5 and df.schema == S.BASE_SCHEMA
    bad = tmp_path / "bad.csv"
    bad.write_text("id,store_nbr,date,family,sales,onpromotion\n1,1,2017-01-01,GROCERY I,5.5,0\n")
    with pytest.raises(Exception):
        R.read_table(spark, str(bad), S.BASE_SCHEMA, fmt="csv").collect()
    overflow = tmp_path / "overflow.csv"
    overflow.write_text("id,date,store_nbr,family,sales,onpromotion\n1,2017-01-01,99999999999,GROCERY I,5.5,0\n")
    with pytest.raises(Exception):
        R.read_table(spark, str(overflow), S.BASE_SCHEMA, fmt="csv").collect()
