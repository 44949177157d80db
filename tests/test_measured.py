"""Contracts of many tables by one action, the published feature tables, and the counters of V3, A2 and P7."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import contracts as C
from shelfcast.operators import joins as J
from shelfcast.operators import splits as SP
from shelfcast.plans import features as FT
from shelfcast.plans import registry as R
from shelfcast.session import scratch_dir

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(scope="module")
def raw(spark):
    return R.ctx_for(spark, SF).raw


def dirty(raw):
    k = F.col("id") % 11
    train = raw.train.withColumns({
        "store_nbr": F.when(k == 1, None).when(k == 2, 99).otherwise(F.col("store_nbr")),
        "id": F.when(k == 3, None).otherwise(F.col("id")),
    }).select(*raw.train.columns)
    return FT.RawTables(
        train.unionByName(raw.train.where(k == 4)), raw.test, raw.stores.unionByName(raw.stores.limit(1)),
        raw.oil.unionByName(raw.oil.limit(2)).withColumn("dcoilwtico", F.when(F.month("date") == 2, -1.0).otherwise(F.col("dcoilwtico"))),
        raw.transactions.unionByName(raw.transactions.limit(3)), raw.holidays,
    )


@pytest.mark.parametrize("make", [lambda raw: raw, dirty])
def test_one_action_measures_what_single_audits_do(raw, make):
    tables = make(raw)
    contracts = {
        **FT.R.source_contracts(tables.oil, tables.transactions, tables.holidays),
        "stores": J.store_contract(tables.stores),
        "train": J.stored_base_contract(tables.train, tables.stores),
        "test": J.stored_base_contract(tables.test, tables.stores),
    }
    found = C.measure_all(contracts)
    for name, contract in contracts.items():
        assert found[name].pop("rows") == contract.df.count()
        assert found[name] == {r.rule: r.violations for r in contract.audit().collect()}, name
    assert any(n for rules in found.values() for n in rules.values()) is (make is dirty)


def test_keys_of_any_shape_are_counted(spark):
    rows = [(1, 2, "a", "b", 0.5), (1, 2, "a", "b", 0.5), (1, 3, "a", "b", 0.5), (None, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b long, c string, d string, e double")
    unique = {"ints": ["a", "b"], "texts": ["c", "d"], "all": ["a", "b", "c", "d", "e"], "double": ["e"]}
    contract = C.Contract(df, {"null_a": F.col("a").isNull()}, unique, non_empty=True)
    found = C.measure_all({"t": contract, "none": C.Contract(df.where("a > 5"), {}, {"one": ["a"]}, True)})
    assert found["t"] == {"rows": 5, **{r.rule: r.violations for r in contract.audit().collect()}}
    assert found["none"] == {"rows": 0, "one": 0, "non_empty": 1}
    nothing = df.where("a > 5").groupBy("a").agg(F.max("b").alias("b"))
    for empty in (nothing, nothing.join(df.select("a").distinct(), "a", "left"), df.where("a > 5")):
        alone = C.measure_all({"t": C.Contract(empty, {"null_a": F.col("a").isNull()}, {"one": ["a"]}, True)})
        assert alone == {"t": {"rows": 0, "null_a": 0, "one": 0, "non_empty": 1}}


def test_messages_name_table_and_rules(raw):
    with pytest.raises(C.ContractError, match=r"oil violates its contract: bad_price=\d+, duplicate_date=2"):
        FT.check_raw(dirty(raw))
    parade = raw.holidays.withColumn("description", F.when(F.col("type") == "Event", "Unclassified Parade").otherwise(F.col("description")))
    with pytest.raises(C.ContractError, match="without an accepted"):
        FT.check_raw(FT.RawTables(raw.train, raw.test, raw.stores, raw.oil, raw.transactions, parade))


def test_nothing_is_published_that_lacks_values(spark, raw, monkeypatch):
    labeled, future = FT.publish_feature_tables(raw)
    assert labeled.columns == list(S.LABELED_COLUMNS) and future.columns == list(S.FUTURE_COLUMNS)
    built = FT.build_feature_tables(raw, validate=False)
    assert all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in zip((labeled, future), built))
    fs = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark) + "/out")

    def folders():
        return {s.getPath().getName() for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)
                if s.getPath().getName().startswith("features-")}

    before = folders()
    spoil = {
        "lack a required value": lambda df: df.withColumn("city", F.when(F.col("id") % 2 == 0, F.col("city"))).select(*df.columns),
        "rows for": lambda df: df.where("id % 2 = 0"),
    }
    for message, change in spoil.items():
        monkeypatch.setattr(FT, "build_feature_tables", lambda raw, validate, change=change: (change(built[0]), built[1]))
        with pytest.raises(C.ContractError, match=message):
            FT.publish_feature_tables(raw)
        assert folders() == before


def test_final_counts(spark, raw):
    labeled = FT.build_feature_tables(raw, validate=False)[0].limit(200).cache()
    base = labeled.select("id", "sales")
    clean = FT.final_counts(labeled, base).first()
    assert (clean.input_rows, clean.output_rows, clean.output_columns) == (200, 200, len(S.LABELED_COLUMNS))
    assert clean.unexpected_missing_cells == clean.duplicate_base_key_rows == 0 and clean.ids_preserved and clean.target_preserved
    swapped = labeled.withColumn("sales", F.col("sales") + F.when(F.col("id") == F.lit(base.first().id), 1.0).otherwise(0.0))
    found = FT.final_counts(swapped.unionByName(swapped.limit(1)), base).first()
    assert (found.duplicate_base_key_rows, found.ids_preserved, found.target_preserved) == (2, False, False)
    none = FT.final_counts(labeled.where("id is null"), base.where("id is null")).first()
    assert (none.input_rows, none.output_rows, none.expected_missing_feature_cells, none.ids_preserved) == (0, 0, 0, True)


def test_split_contract(spark):
    w = R.ctx_for(spark, SF).win
    days = [w.validation_start + dt.timedelta(days=k) for k in range(-3, 32)]
    df = spark.createDataFrame([(x, "a") for x in days], "date date, family string")

    def rules(df):
        return {r.rule: r.violations for r in SP.split_rules(SP.chrono_split(df, w), w).collect()}

    clean = {"unassigned_rows": 0, "validation_dates_missing": 0, "internal_test_dates_missing": 0, "non_empty": 0}
    assert rules(df) == clean
    late = df.unionByName(spark.createDataFrame([(w.future_end + dt.timedelta(days=9), "b")] * 2, df.schema))
    assert rules(late.where(F.col("date") != F.lit(w.validation_end))) == {**clean, "unassigned_rows": 2, "validation_dates_missing": 1}
    assert rules(df.where("date is null"))["non_empty"] == 1
