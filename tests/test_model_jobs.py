"""Bundle fit, save and load, the batch job, the scoring stream, and ids of derived tables."""

import datetime as dt

import pytest
from conftest import future_rows, future_schema
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators.contracts import ContractError
from shelfcast.plans import features as FT
from shelfcast.plans import model as MD
from shelfcast.session import new_output_path
from shelfcast.sources import records as REC
from shelfcast.sources.testdata import Source, windows_ending
from shelfcast.streaming import jobs as SJ

D = dt.date
CUTOFF = D(2017, 8, 15)


@pytest.fixture(scope="module")
def history(spark):
    """80 labeled days of two pairs up to the cutoff; sales depend on weekday and pair."""
    rows = []
    for r in future_rows(start=CUTOFF - dt.timedelta(days=79), days=80):
        rows.append({**r, "sales": 50.0 * r["store_nbr"] + 7.0 * r["day_of_week"]})
    schema = S.feature_schema(has_target=True)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema).cache()


@pytest.fixture(scope="module")
def future(spark):
    schema = S.feature_schema(has_target=False)
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in future_rows()], schema).cache()


@pytest.fixture(scope="module")
def bundle(spark, history):
    train = FT.add_sales_lags(history, history).where("sales_lag_available_count = 4")
    return MD.fit_bundle(train, "Ridge Regression", {"alpha": 1.0}, {"selected_by": "validation rmsle", "rmsle": 0.1})


def test_manifest_tells_the_truth(bundle):
    about = bundle["metadata"]
    assert about["training"] == {"rows": 2 * 45, "start": "2017-07-02", "end": "2017-08-15"}
    assert about["features"]["transformed_count"] == bundle["model"].stages[-1].numFeatures
    assert about["created_at_utc"] and about["engine"]["spark"] and about["evaluation"]["rmsle"] == 0.1


def test_fit_needs_its_evaluation(history):
    train = FT.add_sales_lags(history, history).where("sales_lag_available_count = 4")
    with pytest.raises(ContractError, match="evaluation"):
        MD.fit_bundle(train, "Ridge Regression", {"alpha": 1.0}, {})


def test_batch_job_and_round_trip(spark, bundle, history, future):
    out = new_output_path(spark, "job")
    forecast = MD.run_batch_inference(bundle, history, future, out).orderBy("id").collect()
    assert len(forecast) == 32 and all(r.forecast_sales >= 0 for r in forecast)
    path = new_output_path(spark, "bundle")
    MD.save_bundle(bundle, path)
    with pytest.raises(FileExistsError):
        MD.save_bundle(bundle, path)
    again = MD.run_batch_inference(MD.load_bundle(path), history, future).orderBy("id").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in forecast]
    with pytest.raises(ContractError):
        MD.run_batch_inference(bundle, history, future.where("store_nbr = 1"))
    with pytest.raises(ContractError):
        MD.run_batch_inference(bundle, history.where(F.col("date") < F.lit(CUTOFF)), future)


def test_scoring_stream_of_many_batches(spark, bundle, history, future, tmp_path):
    """20 batches, four of them faulty in different ways, in one backlog; a replay writes nothing twice."""
    faults = {
        3: lambda df: df.where(F.col("date") < F.lit(D(2017, 8, 31))),
        7: lambda df: df.where("store_nbr = 1"),
        11: lambda df: df.withColumn("day_of_week", F.lit(9)),
        15: lambda df: df.withColumn("city", F.when(F.col("id") > 3, F.col("city"))),
    }
    expected = {3: "window:incomplete_pairs,missing_window_dates", 7: "pair_coverage", 11: "record_contract", 15: "record_contract"}
    for k in range(20):
        REC.to_records(faults.get(k, lambda df: df)(future), S.FUTURE_COLUMNS).coalesce(1).write.text(str(tmp_path / f"in/batch={k}"))
    out, refused = str(tmp_path / "out"), str(tmp_path / "refused")
    for run in range(2):
        SJ.run_scoring_stream(spark, str(tmp_path / "in"), bundle, history, out, refused, str(tmp_path / f"ckpt{run}"))
        scored = spark.read.parquet(out).groupBy("batch").count().collect()
        assert {int(r["batch"]): r["count"] for r in scored} == {k: 32 for k in range(20) if k not in faults}
        reasons = spark.read.parquet(refused).select("batch", "reason").distinct().collect()
        assert {int(r["batch"]): r["reason"] for r in reasons} == expected


def test_scoring_stream_of_pieces(spark, bundle, history, future, tmp_path):
    """One batch over five triggers, one whole, one that never completes, one with a piece too late; every
    call is a restart from the checkpoints."""
    work, records = str(tmp_path / "work"), REC.to_records(future, S.FUTURE_COLUMNS)
    cut = [records.where(F.get_json_object("record", "$.id").cast("int") % 5 == k) for k in range(5)]

    def send(batch, piece):
        target = tmp_path / "in" / (f"batch={batch}" if batch else "clock")
        piece.coalesce(1).write.mode("append").text(str(target))

    def run(patience=3600):
        SJ.run_piecewise_scoring_stream(spark, str(tmp_path / "in"), bundle, history, work, patience)

    def scored():
        rows = spark.read.schema("batch string").parquet(f"{work}/out").groupBy("batch").count().collect()
        return {r["batch"]: r["count"] for r in rows}

    def refused(kind):
        rows = spark.read.parquet(f"{work}/quarantine/{kind}").select("batch", "reason").distinct().collect()
        return {r["batch"]: r["reason"] for r in rows}

    for k, piece in enumerate(cut):
        send("five", piece)
        if k < 2:
            send("never", piece)
        if k == 1:
            send("whole", records)
        run()
        assert scored() == {**({"whole": 32} if k >= 1 else {}), **({"five": 32} if k == 4 else {})}
    send("five", cut[2])
    run()
    assert scored() == {"whole": 32, "five": 32} and refused("late") == {"five": "after_release"}
    assert spark.read.parquet(f"{work}/quarantine/late").count() == cut[2].count()
    # Nothing more comes of two batches, and the clock goes on: they are refused with what they lack, once.
    send("never", cut[2])
    send("other", cut[0])
    run(0)
    for _ in range(3):
        send(None, records.limit(1))
        run(0)
    assert scored() == {"whole": 32, "five": 32}
    reasons = refused("refused")
    assert set(reasons) == {"never", "other"} and all("incomplete_pairs" in r for r in reasons.values())
    assert spark.read.parquet(f"{work}/quarantine/refused").where("batch = 'never'").count() == sum(c.count() for c in cut[:3])


def test_envelopes(spark):
    bodies = ['{"records":[{"a":1},{"a":2}]}', '{"records":[]}', '{"records":[{"a":1}],"x":1}', "[1]", "{", '{"rows":[]}', None]
    good, bad = REC.open_envelopes(spark.createDataFrame([(b,) for b in bodies], "body string"), "body")
    assert [r["record"] for r in good.collect()] == ['{"a":1}', '{"a":2}']
    assert sorted(r["reason"] for r in bad.collect()) == [
        "extra_keys", "no_records", "no_records_key", "unparseable_body", "unparseable_body", "unparseable_body"
    ]


def test_records_refuse_what_their_types_cannot_hold(spark, future):
    record = F.col("record")
    good = REC.to_records(future.limit(1), S.FUTURE_COLUMNS)
    cases = {
        "abc": F.regexp_replace(record, '"oil_lag_16":[^,}]*', '"oil_lag_16":"abc"'),
        "absent": F.regexp_replace(record, '"oil_lag_16":[^,}]*,', ""),
        "null": F.regexp_replace(record, '"oil_lag_16":[^,}]*', '"oil_lag_16":null'),
        "float": F.regexp_replace(record, '"transactions_lag_16":[^,}]*', '"transactions_lag_16":1234.5'),
    }
    valid = {k: REC.parse_records(good.select(c.alias("record")))[0] for k, c in cases.items()}
    assert {k: v.count() for k, v in valid.items()} == {"abc": 0, "absent": 0, "null": 1, "float": 1}
    assert valid["float"].first()["transactions_lag_16"] == 1234.5


def test_ids_and_windows_of_other_sizes(spark, tmp_path):
    """1,200 stores and 150 families: every key has an id of its own, and the windows end with the data."""
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    table("nation", [(i, f"N{i}", i % 5) for i in range(1200)], "n_nationkey int, n_name string, n_regionkey int")
    table("region", [(i, f"R{i}") for i in range(5)], "r_regionkey int, r_name string")
    table("supplier", [(i, f"S{i}", i, 0.0) for i in range(1200)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    table("part", [(i, "p", "b", f"type {i:03d}", 1, 1.0) for i in range(150)],
          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    lines = spark.range(20_000).select(
        (F.col("id") % 150).alias("l_partkey"), ((F.col("id") * 7) % 1200).alias("l_suppkey"),
        F.lit(10.0).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
        F.date_add(F.lit(D(2030, 1, 1)), (F.col("id") % 100).cast("int")).cast("timestamp_ntz").alias("l_shipdate"),
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    src = Source(spark, str(tmp_path))
    assert src.windows == windows_ending(D(2030, 4, 10)) and src.windows.future_start == D(2030, 3, 26)
    rows = src.with_id(src.sales_all())
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    assert n == ids == src.sales_all().count()
    assert src.sales().count() + src.sales_all(start=src.windows.future_start).count() == n
