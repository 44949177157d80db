"""Property tests: exact lags equal a dictionary lookup; missing stays missing."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfcast import schemas as S
from shelfcast.operators.lags import exact_lags

D0 = dt.date(2020, 1, 1)
days = st.integers(min_value=0, max_value=90)
stores = st.integers(min_value=1, max_value=3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    hist=st.dictionaries(st.tuples(days, stores), st.integers(min_value=0, max_value=999), min_size=1, max_size=60),
    targets=st.sets(st.tuples(days, stores), min_size=1, max_size=20),
)
def test_exact_lags_equal_dict_lookup(spark, hist, targets):
    h = spark.createDataFrame(
        [(D0 + dt.timedelta(days=d), s, v) for (d, s), v in hist.items()], "date date, store_nbr int, transactions int"
    )
    b = spark.createDataFrame([(D0 + dt.timedelta(days=d), s) for d, s in targets], "date date, store_nbr int")
    out = exact_lags(b, h, ["store_nbr"], "transactions", S.SAFE_LAGS, "transactions",
                     count_col="transactions_lag_available_count")
    got = {(r.date, r.store_nbr): r for r in out.collect()}
    assert len(got) == len(targets)
    for d, s in targets:
        row = got[(D0 + dt.timedelta(days=d), s)]
        expected = [hist.get((d - lag, s)) for lag in S.SAFE_LAGS]
        assert [row[f"transactions_lag_{lag}"] for lag in S.SAFE_LAGS] == expected
        assert row.transactions_lag_available_count == sum(v is not None for v in expected)
