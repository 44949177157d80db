"""Preprocessing contracts: as-of oil, exact lags, holiday meaning, store join, final check."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import holidays as H
from shelfcast.operators import joins as J
from shelfcast.operators.contracts import ContractError
from shelfcast.operators.lags import asof_lookup, exact_lags
from shelfcast.plans import features as FT

D = dt.date


def test_oil_asof_uses_last_published_value_and_age(spark):
    dates = spark.createDataFrame([(D(2017, 2, 1),)], "date date")
    oil = spark.createDataFrame(
        [(D(2017, 1, 15), 70.0), (D(2017, 1, 16), None), (D(2017, 1, 20), 80.0)], "date date, dcoilwtico double"
    )
    row = FT.oil_lookup(dates, oil).first()
    assert row.oil_lag_16 == 70.0  # reference day 01-16 has a null price -> last published is 01-15
    assert row.oil_lag_16_age_days == 1
    assert row.oil_lag_21 is None and row.oil_lag_21_age_days is None  # nothing on or before 01-11


def test_asof_matches_pandas_merge_asof(spark):
    rnd = random.Random(7)
    start = D(2020, 1, 1)
    obs = sorted({start + dt.timedelta(days=rnd.randrange(0, 120)) for _ in range(40)})
    series = [(d, (None if rnd.random() < 0.2 else float(rnd.randrange(1, 100)))) for d in obs]
    targets = sorted({start + dt.timedelta(days=rnd.randrange(0, 160)) for _ in range(60)})
    got = asof_lookup(
        spark.createDataFrame([(t,) for t in targets], "date date"),
        spark.createDataFrame(series, "date date, dcoilwtico double"),
        S.SAFE_LAGS, "oil", "dcoilwtico",
    ).toPandas().set_index("date").sort_index()
    o = pd.DataFrame(series, columns=["src", "v"]).dropna()
    o["src"] = pd.to_datetime(o["src"])
    for lag in S.SAFE_LAGS:
        ref = pd.DataFrame({"date": pd.to_datetime(targets)})
        ref["ref"] = ref["date"] - pd.Timedelta(days=lag)
        m = pd.merge_asof(ref.sort_values("ref"), o.sort_values("src"), left_on="ref", right_on="src", direction="backward")
        m = m.set_index(m["date"].dt.date).sort_index()
        for d in targets:
            exp_v = m.loc[d, "v"]
            exp_a = (m.loc[d, "ref"] - m.loc[d, "src"]).days if pd.notna(m.loc[d, "src"]) else None
            got_v = got.loc[d, f"oil_lag_{lag}"]
            got_a = got.loc[d, f"oil_lag_{lag}_age_days"]
            if pd.isna(exp_v):
                assert pd.isna(got_v) and pd.isna(got_a)
            else:
                assert got_v == exp_v and int(got_a) == exp_a


def test_transaction_lags_are_exact_not_carried(spark):
    base = spark.createDataFrame([(D(2017, 2, 1), 1), (D(2017, 2, 1), 2)], "date date, store_nbr int")
    tx = spark.createDataFrame(
        [(D(2017, 1, 15), 1, 99), (D(2017, 1, 16), 1, 10), (D(2017, 1, 16), 2, 20)],
        "date date, store_nbr int, transactions int",
    )
    out = exact_lags(base, tx, ["store_nbr"], "transactions", S.SAFE_LAGS, "transactions",
                     count_col="transactions_lag_available_count")
    rows = {r.store_nbr: r for r in out.collect()}
    assert rows[1].transactions_lag_16 == 10 and rows[2].transactions_lag_16 == 20
    assert rows[1].transactions_lag_21 is None
    assert rows[1].transactions_lag_available_count == 1


def test_exact_lags_require_unique_history(spark):
    base = spark.createDataFrame([(D(2017, 2, 1), 1)], "date date, store_nbr int")
    tx = spark.createDataFrame([(D(2017, 1, 16), 1, 1), (D(2017, 1, 16), 1, 2)], "date date, store_nbr int, transactions int")
    with pytest.raises(ContractError):
        exact_lags(base, tx, ["store_nbr"], "transactions", S.SAFE_LAGS, "transactions")


def _one_store(spark):
    return spark.createDataFrame([(1, "Quito", "Pichincha", "A", 1)], "store_nbr int, city string, state string, store_type string, store_cluster int")


def _holidays(spark, rows):
    return spark.createDataFrame(rows, S.HOLIDAY_SCHEMA)


def test_holiday_meaning(spark):
    hol = _holidays(spark, [
        (D(2017, 1, 1), "Holiday", "National", "Ecuador", "Primer dia", True),
        (D(2017, 1, 2), "Transfer", "National", "Ecuador", "Traslado Primer dia", False),
        (D(2017, 1, 3), "Work Day", "National", "Ecuador", "Recupero", False),
        (D(2017, 1, 4), "Event", "National", "Ecuador", "Dia de la Madre", False),
        (D(2017, 1, 5), "Event", "National", "Ecuador", "Terremoto Manabi", False),
    ])
    sd = spark.createDataFrame([(D(2017, 1, d), 1) for d in range(1, 6)], "date date, store_nbr int")
    flags = {r.date.day: r for r in H.holiday_flags(hol, _one_store(spark), sd).collect()}
    assert flags[1].is_holiday == 0 and flags[1].is_holiday_transfer_source == 1
    assert flags[2].is_holiday == 1 and flags[2].is_holiday_transfer_destination == 1
    assert flags[3].is_special_work_day == 1
    assert flags[4].is_planned_event == 1
    assert 5 not in flags
    ev = H.holiday_evidence(hol, _one_store(spark)).first()
    assert ev.earthquake_event_rows_excluded == 1
    assert ev.maximum_active_events_on_one_store_date == 1


def test_unknown_event_raises(spark):
    hol = _holidays(spark, [(D(2017, 1, 1), "Event", "National", "Ecuador", "Unclassified Parade", False)])
    with pytest.raises(ContractError, match="without an accepted"):
        H.scoped_lookups(hol)


def test_regional_and_local_scopes_and_max_active(spark):
    stores = spark.createDataFrame(
        [(1, "Quito", "Pichincha", "A", 1), (2, "Guayaquil", "Guayas", "B", 2)],
        "store_nbr int, city string, state string, store_type string, store_cluster int",
    )
    hol = _holidays(spark, [
        (D(2017, 3, 1), "Holiday", "Regional", "Guayas", "Fiesta Guayas", False),
        (D(2017, 3, 1), "Holiday", "Local", "Guayaquil", "Fundacion", False),
        (D(2017, 3, 1), "Holiday", "National", "Ecuador", "Carnaval", False),
        (D(2017, 3, 2), "Holiday", "Local", "Atlantis", "Nowhere", False),
    ])
    sd = spark.createDataFrame([(D(2017, 3, 1), 1), (D(2017, 3, 1), 2), (D(2017, 3, 2), 1)], "date date, store_nbr int")
    f = {(r.date.day, r.store_nbr): r for r in H.holiday_flags(hol, stores, sd).collect()}
    assert f[(1, 2)].is_regional_schedule == 1 and f[(1, 2)].is_local_schedule == 1
    assert f[(1, 1)].is_regional_schedule == 0 and f[(1, 1)].is_national_schedule == 1
    assert (2, 1) not in f
    ev = H.holiday_evidence(hol, stores).first()
    assert ev.maximum_active_events_on_one_store_date == 3
    assert ev.unmapped_scheduled_source_rows == 1
    assert ev.mapped_scheduled_store_rows == 4


def _base(spark):
    return spark.createDataFrame(
        [(1, D(2017, 1, 1), 1, "GROCERY I", 5.0, 0)],
        "id long, date date, store_nbr int, family string, sales double, onpromotion long",
    )


def test_store_join_preserves_rows_and_rejects_missing_metadata(spark):
    out = J.store_join(_base(spark), _one_store(spark))
    assert out.count() == 1 and out.first().city == "Quito"
    bad = spark.createDataFrame([(1, None, "Pichincha", "A", 1)], "store_nbr int, city string, state string, store_type string, store_cluster int")
    with pytest.raises(ContractError, match="missing_store_metadata"):
        J.store_join(_base(spark), bad)


def test_store_join_rejects_unknown_store(spark):
    other = spark.createDataFrame([(9, "X", "Y", "A", 1)], "store_nbr int, city string, state string, store_type string, store_cluster int")
    with pytest.raises(ContractError, match="store_absent_from_stores"):
        J.store_join(_base(spark), other)


def test_final_check_detects_changed_target(spark):
    base = _base(spark)
    changed = base.withColumn("sales", F.lit(6.0))
    rules = {r.rule: r.violations for r in FT.final_rules(changed, base).collect()}
    assert rules["target_changed"] == 1 and rules["lost_rows"] == 0


def test_csv_rejects_keep_every_line(spark, tmp_path):
    """Short, long and mistyped lines, quotes with separators, empty fields, empty lines and files."""
    from pyspark.sql import types as T

    from shelfcast.sources import readers as R

    schema = T.StructType([T.StructField("date", T.DateType()), T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType())])
    lines = ["2020-01-01,1,a", '2020-01-02,2,"b, c"', "2020-01-03,,", "2020-01-04,4", "2020-01-05,5,e,f", "2020-01-06,six,g",
             "2020-02-30,7,h", '2020-01-08,99999999999,"x, y"', "", "2020-01-09,9,i"]
    folder = tmp_path / "table"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join(["date,n,name", *lines[:5]]) + "\n")
    (folder / "b.csv").write_text("\n".join(["date,n,name", *lines[5:]]))
    (folder / "c.csv").write_text("date,n,name\n")
    good, bad = R.read_csv_with_rejects(spark, str(folder), schema)
    assert good.schema.names == schema.names and good.count() == 4
    assert sorted((str(r.date), r.n, r.name) for r in good.collect()) == [
        ("2020-01-01", 1, "a"), ("2020-01-02", 2, "b, c"), ("2020-01-03", None, None), ("2020-01-09", 9, "i")
    ]
    assert {r.rejected_line: r.reason for r in bad.collect()} == {
        lines[3]: "field_count", lines[4]: "field_count", lines[5]: "bad_value", lines[6]: "bad_value", lines[7]: "bad_value"
    }
    assert bad.groupBy("reason").count().count() == 2
    (folder / "a.csv").write_text("n,date,name\n")
    with pytest.raises(R.ContractError, match="header"):
        R.read_csv_with_rejects(spark, str(folder / "a.csv"), schema)
