"""The joins that derive the store-sales tables: sides that grow with the input are not broadcast."""

import datetime as dt

from pyspark.sql import functions as F

from shelfcast.sources.testdata import Source


def source(spark, tmp_path) -> Source:
    """Lines of two parts, one of them listed twice, a null and an unknown key; orders of two customers."""
    day = dt.datetime(2001, 3, 1)
    tables = {
        "part": ([(1, "TIN"), (2, "COPPER"), (2, "COPPER"), (None, "NONE")], "p_partkey long, p_type string"),
        "supplier": ([(7, 0), (8, 4)], "s_suppkey long, s_nationkey int"),
        "lineitem": (
            [(1, 7, 10.0, 0.0, day), (1, 7, 20.0, 0.1, day), (2, 8, 5.0, 0.0, day), (None, 8, 1.0, 0.0, day), (9, 8, 1.0, 0.0, day)],
            "l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz",
        ),
        "customer": ([(3, 1), (4, 2)], "c_custkey long, c_nationkey int"),
        "orders": ([(3, day), (3, day), (4, day), (None, day)], "o_custkey long, o_orderdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return Source(spark, str(tmp_path))


def joins(df, key: str) -> set[str]:
    """The kinds of the physical joins by this key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {line.split("Join")[0].split()[-1] for line in plan.splitlines() if "Join" in line and key in line}


def test_parts_and_customers_are_dealt_by_key(spark, tmp_path):
    src = source(spark, tmp_path)
    sales, transactions = src.sales_all(), src.transactions()
    assert joins(sales, "p_partkey") == {"SortMerge"} and joins(transactions, "c_custkey") == {"SortMerge"}
    found = sorted((r.store_nbr, r.family, r.sales, r.onpromotion) for r in sales.collect())
    assert found == [(1, "TIN", 28.0, 1), (5, "COPPER", 10.0, 0)]
    assert sorted((r.store_nbr, r.transactions) for r in transactions.select("store_nbr", F.col("transactions")).collect()) == [(2, 2), (3, 1)]
