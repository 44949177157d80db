"""History laid out by series key, so that each new batch reads it without an exchange.

The history is written once, bucketed and sorted by (store, family). Pair coverage and lags of a batch
group and join by exactly these keys: only the batch is shuffled to the buckets, or broadcast.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import nonnull_count
from shelfcast.session import new_output_path

#: Buckets of a history table; a bucket should be some hundred MB at the size it is to reach.
BUCKETS = 32


def write_history(history: DataFrame, buckets: int = BUCKETS) -> str:
    """Write (date, store_nbr, family, sales) bucketed by pair, under the shared folder; the table's name.

    A pair that holds much of the history is one bucket's; its rows are bounded by the calendar, since
    base keys are unique.
    """
    name = f"history_{uuid.uuid4().hex[:12]}"
    rows = history.select(*S.INFERENCE_HISTORY_COLUMNS).repartition(buckets, *S.PAIR_KEY)
    writer = rows.write.bucketBy(buckets, *S.PAIR_KEY).sortBy(*S.PAIR_KEY)
    writer.option("path", new_output_path(history.sparkSession, "history")).saveAsTable(name)
    return name


def read_history(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def batch_lags(
    batch: DataFrame, history: DataFrame, cutoff: dt.date, lags: Sequence[int] = tuple(S.SAFE_LAGS), prefix: str = "sales"
) -> DataFrame:
    """J5 for a batch that starts after ``cutoff``: exact lags of its pairs, missing stays missing.

    Each pair's last ``max(lags)`` days become one map from date to value, at most so many entries; the map is
    joined by pair and looked up at each row's dates. Of a date that occurs twice for a pair the lookup is refused.
    """
    start = cutoff - dt.timedelta(days=max(lags) - 1)
    recent = history.where(F.col("date").between(F.lit(start), F.lit(cutoff)))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("date", "sales"))))
    by_pair = recent.groupBy(*S.PAIR_KEY).agg(entries.alias("_sales"))
    joined = batch.join(by_pair, list(S.PAIR_KEY), "left")
    names = {f"{prefix}_lag_{lag}": F.try_element_at("_sales", F.date_sub("date", lag)) for lag in lags}
    out = joined.withColumns(names).select(*batch.columns, *names)
    return out.withColumn(f"{prefix}_lag_available_count", nonnull_count(list(names)))
