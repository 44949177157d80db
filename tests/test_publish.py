"""Tables published whole or not at all, and facts from file footers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast.operators.contracts import ContractError
from shelfcast.session import new_output_path
from shelfcast.sources import publish as PB
from shelfcast.sources import readers as R


def ids(spark, path):
    return sorted(r.id for r in PB.read_published(spark, path).collect())


def versions(spark, path):
    fs, folder = PB._fs(spark, f"{path}/data")
    return len(fs.listStatus(folder))


def test_versions_follow_each_other(spark):
    path = new_output_path(spark, "table")
    assert PB.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        PB.read_published(spark, path)
    for number in (1, 2, 3):
        staged = PB.stage(spark.range(number), path, {"negative": F.col("id") < 0})
        assert PB.publish(spark, staged, number) == number
        assert ids(spark, path) == list(range(number)) and PB.manifest(spark, path)["rows"] == number
    assert PB.sweep(spark, path, keep=2) == 1 and ids(spark, path) == [0, 1, 2]


@pytest.mark.parametrize("make, options, message", [
    (lambda spark: spark.range(-1, 4), {}, "negative=1"),
    (lambda spark: spark.range(4), {"expected_rows": 5}, "4 rows, 5 expected"),
    (lambda spark: spark.range(4), {"check": lambda df: 1 / (df.count() - 4)}, "division"),
])
def test_a_failing_check_leaves_what_was(spark, make, options, message):
    path = new_output_path(spark, "table")
    PB.publish(spark, PB.stage(spark.range(2), path))
    with pytest.raises((ContractError, ZeroDivisionError), match=message):
        PB.publish(spark, PB.stage(make(spark), path, {"negative": F.col("id") < 0}), **options)
    assert ids(spark, path) == [0, 1] and versions(spark, path) == 1


def test_a_crash_between_the_steps(spark, monkeypatch):
    """After staging, after the marker: readers keep the former version, the next writer gets through."""
    path = new_output_path(spark, "table")
    PB.publish(spark, PB.stage(spark.range(2), path))
    PB.stage(spark.range(9), path)  # and the writer is gone
    assert ids(spark, path) == [0, 1]
    fs, marker = PB._fs(spark, PB._manifest(path, 2) + ".owner")
    fs.create(marker, False).close()  # another one is gone before it put its manifest in place
    staged = PB.stage(spark.range(3), path)
    with pytest.raises(PB.PublishConflict):
        PB.publish(spark, staged)
    assert ids(spark, path) == [0, 1]
    monkeypatch.setattr(PB, "LEASE_SECONDS", -1)
    assert PB.publish(spark, PB.stage(spark.range(3), path)) == 2
    assert ids(spark, path) == [0, 1, 2] and PB.sweep(spark, path) == 2 and ids(spark, path) == [0, 1, 2]


def test_of_two_writers_one_wins(spark):
    path = new_output_path(spark, "table")
    first, second = PB.stage(spark.range(2), path), PB.stage(spark.range(5), path)
    assert PB.publish(spark, second) == 1
    with pytest.raises(PB.PublishConflict):
        PB.publish(spark, first)
    assert ids(spark, path) == [0, 1, 2, 3, 4] and versions(spark, path) == 1
    # Who starts again from what is there gets through.
    assert PB.publish(spark, PB.stage(spark.range(1), path)) == 2


def test_forecasts(spark):
    path = new_output_path(spark, "forecast")
    schema = "id long, date date, store_nbr int, family string, forecast_sales double"
    rows = [(k, dt.date(2020, 1, 1), 1, "a", float(k)) for k in range(3)]
    assert R.publish_forecast(spark.createDataFrame(rows, schema), path, 3) == 1
    for bad in ([(9, dt.date(2020, 1, 1), 1, "a", float("nan"))], [(9, dt.date(2020, 1, 1), 1, "a", -1.0)], []):
        with pytest.raises(ContractError, match="non_finite|negative|non_empty"):
            R.publish_forecast(spark.createDataFrame(bad, schema), path)
    assert PB.read_published(spark, path).count() == 3


def test_latest_date_comes_from_footers(spark):
    path = new_output_path(spark, "history")
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), k % 3, "a", float(k)) for k in range(50)] + [(None, 1, "a", 0.0)]
    spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double").repartition(4).write.parquet(path)
    end = dt.date(2020, 2, 19)
    assert PB.footer_bounds(spark, path, "date", "sales") == {"date": (dt.date(2020, 1, 1), end), "sales": (0.0, 49.0)}
    plan = PB.footer_plan(spark, path, "date")._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(date), MAX(date)]" in plan and "ReadSchema: struct<min(date):date,max(date):date>" in plan
    window = R.history_window_at(spark, path, end)
    assert window.count() == 35 and window.agg(F.min("date")).first()[0] == dt.date(2020, 1, 16)
    with pytest.raises(ContractError, match="differs from the training cutoff"):
        R.history_window_at(spark, path, end + dt.timedelta(days=1))
    # The caller's session reads as before.
    assert "BatchScan" not in spark.read.parquet(path)._jdf.queryExecution().toString()
