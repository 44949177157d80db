"""Summarise the physical plans of the headline queries.

For each query: number of shuffles (Exchange), join strategies, any
nested-loop / cartesian joins, window operators, and the filters pushed to
parquet scans. AQE is switched off here so the static plan is shown.

    python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

sys.path.insert(0, ".")

from shelfcast.plans import registry  # noqa: E402
from shelfcast.session import get_spark  # noqa: E402

HEADLINE = ["feature_table", "labeled_with_sales_lags", "exact_lags_sales", "asof_lags", "holiday_flags",
            "error_summary_store", "promotion_summary", "rolling_28d", "best_per_group", "request_rollup"]
OPS = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
       "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Scan parquet"]


def summary(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    counts = {op: len(re.findall(rf"[-+:] (\* )?{op} ", head)) + len(re.findall(rf"^{op} ", head, re.M)) for op in OPS}
    pushed = sorted({m for m in re.findall(r"PushedFilters: \[(.+?)\]", text) if m})
    return {k: v for k, v in counts.items() if v} | {"pushed": pushed[:3]}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(master="local[4]", shuffle_partitions=8, extra={"spark.sql.adaptive.enabled": "false"})
    for name in HEADLINE:
        print(name, summary(registry.QUERIES[name](spark, sf)))


if __name__ == "__main__":
    main()
