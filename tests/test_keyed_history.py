"""History laid out by pair: equal results, and no exchange above its scan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.operators import joins as J
from shelfcast.operators import keyed_history as KH
from shelfcast.plans import features as FT

CUTOFF = dt.date(2020, 3, 31)


@pytest.fixture(scope="module")
def tables(spark):
    pairs = [(s, f) for s in range(1, 8) for f in ("a", "b", "c")]
    rows = [(CUTOFF - dt.timedelta(days=k), s, f, float(100 * s + k)) for s, f in pairs for k in range(90) if (k + s) % 9]
    history = spark.createDataFrame(rows, "date date, store_nbr int, family string, sales double")
    batch = spark.createDataFrame(
        [(n, CUTOFF + dt.timedelta(days=d), s, f) for n, (d, (s, f)) in enumerate((d, p) for d in range(1, 17) for p in [*pairs, (9, "new")])],
        "id long, date date, store_nbr int, family string",
    )
    return history, batch, KH.read_history(spark, KH.write_history(history, 4))


def exchanges_above_scans(df, table):
    """Exchanges on the way from the scan of the table to the root of the physical plan, with adaptive planning off."""
    found = []

    def walk(plan, above):
        kind = plan.getClass().getSimpleName()
        if kind == "FileSourceScanExec" and table in plan.toString():
            found.append(above)
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k), above + (kind == "ShuffleExchangeExec"))

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return found


def test_lags_and_coverage_are_the_same(tables):
    history, batch, kept = tables
    columns = [*batch.columns, *S.SALES_LAG_COLUMNS, "sales_lag_available_count"]
    expected = FT.add_sales_lags(batch, history).select(*columns)
    got = KH.batch_lags(batch, kept, CUTOFF).select(*columns)
    assert got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty() and got.count() == batch.count()
    assert J.pair_coverage(batch, kept).first() == J.pair_coverage(batch, history).first() == (0, 1)
    assert got.where("store_nbr = 9 AND sales_lag_available_count > 0").count() == 0


def test_the_history_is_not_exchanged(spark, tables):
    _, batch, kept = tables
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert exchanges_above_scans(KH.batch_lags(batch, kept, CUTOFF), "history_") == [0]
        # The coverage's only exchange is that of its two counts.
        assert exchanges_above_scans(J.pair_coverage(batch, kept), "history_") == [1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_repeated_date_is_refused(tables):
    history, batch, _ = tables
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        KH.batch_lags(batch, history.unionByName(history.where(F.col("date") == F.lit(CUTOFF))), CUTOFF).collect()
