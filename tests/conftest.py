import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfcast import schemas as S  # noqa: E402
from shelfcast.session import get_spark  # noqa: E402

D = dt.date


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", shuffle_partitions=4, app="shelfcast-tests")
    yield s


def future_rows(start=D(2017, 8, 16), days=16):
    """Two store-family pairs x ``days`` days with every future column + sales-lag numerics."""
    pairs = [
        (1, "GROCERY I", "Quito", "Pichincha", "A", 1),
        (2, "BEVERAGES", "Guayaquil", "Guayas", "B", 2),
    ]
    rows, rid = [], 1
    for p in pairs:
        for k in range(days):
            d = start + dt.timedelta(days=k)
            r = {
                "id": rid, "date": d, "store_nbr": p[0], "family": p[1], "onpromotion": 3,
                "city": p[2], "state": p[3], "store_type": p[4], "store_cluster": p[5],
                "month": d.month, "day_of_month": d.day, "day_of_week": d.isoweekday(),
            }
            for c in S.OIL_LAG_COLUMNS + S.SALES_LAG_COLUMNS:
                r[c] = 0.0
            for c in S.OIL_AGE_COLUMNS + S.TRANSACTION_LAG_COLUMNS + ["transactions_lag_available_count"]:
                r[c] = 0
            r["sales_lag_available_count"] = 0
            for c in S.HOLIDAY_FEATURE_COLUMNS:
                r[c] = 0
            rows.append(r)
            rid += 1
    return rows


def future_schema():
    from pyspark.sql import types as T

    fields = list(S.feature_schema(has_target=False).fields)
    fields += [T.StructField(c, T.DoubleType()) for c in S.SALES_LAG_COLUMNS]
    fields += [T.StructField("sales_lag_available_count", T.IntegerType())]
    return T.StructType(fields)


@pytest.fixture()
def future_df(spark):
    sch = future_schema()
    rows = [tuple(r[f.name] for f in sch.fields) for r in future_rows()]
    return spark.createDataFrame(rows, sch)
