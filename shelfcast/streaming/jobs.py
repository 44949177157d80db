"""Structured Streaming jobs.

* ``run_rollup_stream``: request-log files -> windowed per-path rollup in
  update mode (watermark-bounded state); changed windows are written per
  micro-batch and ``latest_rollup`` reads the newest version (checkpointed,
  restartable after executor or driver loss).
* ``run_scoring_stream`` (R3): arriving folders of JSON Lines records, each a
  complete future batch; batches are parsed and validated (S17/V8), checked
  for the window and pair coverage, given exact sales lags and scored; a
  refused batch is written whole to a quarantine folder with its reason.
* ``run_piecewise_scoring_stream`` (R3): the same for batches that arrive in any
  number of pieces, put together by keyed state with a timeout.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if
from shelfcast.operators import guards as G
from shelfcast.plans import model as MD
from shelfcast.plans.features import add_sales_lags
from shelfcast.session import materialize
from shelfcast.sources.records import parse_records
from shelfcast.streaming.requests import path_rollup_stream


class RollupRun(NamedTuple):
    path: str
    #: Rows of the state (one for each window and path that a task met) that came behind the watermark and were
    #: left out: 0 means that nothing is missing.
    late: int


def run_rollup_stream(spark: SparkSession, source: DataFrame, out_path: str, checkpoint: str,
                      window: str = "1 day", watermark: str = "1 hour") -> RollupRun:
    """Update-mode rollup: only windows changed by a micro-batch are emitted, each
    micro-batch in a folder of its own that a replay writes over; state for windows behind the watermark is
    dropped, so state stays bounded on an endless stream. What comes later than ``watermark`` after the
    newest event can't be added any more; how much that was is part of the result. ``latest_rollup``
    reads the newest version of every (window, path)."""
    agg = path_rollup_stream(source, window, watermark).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "path", "request_count", "average_ms", "maximum_ms",
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (
        agg.writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    operators = [op for progress in q.recentProgress for op in progress.stateOperators]
    return RollupRun(out_path, sum(op.numRowsDroppedByWatermark for op in operators))


def latest_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Newest emitted version per (window_start, path): a partial aggregate, no window."""
    rows = spark.read.parquet(path)
    vals = ["window_end", "request_count", "average_ms", "maximum_ms"]
    best = rows.groupBy("window_start", "path").agg(F.max(F.struct("batch_id", *vals)).alias("_b"))
    return best.select("window_start", "path", *[F.col(f"_b.{c}").alias(c) for c in vals])


def run_scoring_stream(
    spark: SparkSession,
    input_dir: str,
    bundle: dict[str, Any],
    history: DataFrame,
    out_path: str,
    quarantine_path: str,
    checkpoint: str,
    max_files: int | None = None,
) -> str:
    """Each arriving ``batch=<key>`` directory holds one complete future batch
    as JSON Lines (written by the producer, then moved into place whole).
    A micro-batch may carry any number of batches: all are validated by
    grouping over the batch key and scored together. Output and quarantine go to a
    folder of the micro-batch, which a replay writes over. ``max_files`` bounds
    the files of a micro-batch; it needs producers that write a batch as one file.
    """
    hist = history.select("date", "store_nbr", "family", "sales")
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.text(input_dir).select(F.col("value").alias("record"), _batch_key().alias("batch"))

    def score(records: DataFrame, batch_id: int) -> None:
        _score_records(records, batch_id, bundle, hist, out_path, quarantine_path)

    q = (
        stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return out_path


def _batch_key():
    return F.regexp_extract(F.input_file_name(), r"batch=([^/]+)", 1)


def _score_records(
    records: DataFrame, batch_id: int, bundle: dict[str, Any], history: DataFrame, out_path: str, quarantine_path: str
) -> None:
    """Score the whole batches among (record, batch), quarantine the others; one folder a micro-batch each."""
    records = records.persist()
    try:
        valid, _ = parse_records(records, carry=["batch"])
        reasons = materialize(batch_reasons(records, valid, history, MD.training_end(bundle)), "stream-reasons")
        refused = records.join(reasons, "batch")
        refused.write.mode("overwrite").parquet(f"{quarantine_path}/batch_id={batch_id}")
        good = valid.join(reasons, "batch", "left_anti")
        feats = add_sales_lags(good, history, check_unique=False)
        scored = MD.score_batch(bundle, feats, check_window=False, carry=["batch"])
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        scored.unpersist()
    finally:
        records.unpersist()


_RELEASE = "batch string, records long, outcome string, after timestamp, upto timestamp"
_ASSEMBLY = "records long, last long, released boolean"


def _assemble(expected: int, patience_ms: int):
    """State of one batch: its records so far, when the last piece came, and whether it was released."""

    def run(key: tuple[Any, ...], pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def release(records: int, outcome: str, after: int, upto: int) -> pd.DataFrame:
            times = (pd.Timestamp(t, unit="ms") for t in (after, upto))
            return pd.DataFrame([(key[0], records, outcome, *times)], columns=["batch", "records", "outcome", "after", "upto"])

        records, last, released = state.get if state.exists else (0, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not released:
                yield release(records, "expired", 0, last)
            return
        came, before = 0, last
        for piece in pieces:
            came += len(piece)
            last = max(last, int(piece["arrived"].max().timestamp() * 1000))
        records += came
        if released:
            yield release(came, "late", before, last)
        elif records >= expected:
            released = True
            yield release(records, "complete", 0, last)
        state.update((records, last, released))
        state.setTimeoutTimestamp(max(last + patience_ms, state.getCurrentWatermarkMs() + 1))

    return run


def run_piecewise_scoring_stream(
    spark: SparkSession,
    input_dir: str,
    bundle: dict[str, Any],
    history: DataFrame,
    work_dir: str,
    patience_seconds: int = 3600,
    max_files: int | None = None,
) -> str:
    """Score batches that arrive in pieces; returns ``work_dir`` with folders ``out`` and ``quarantine``.

    Any number of files under ``batch=<key>`` folders make up a batch. One stream lands the records in
    a table partitioned by batch, with the time they came (that of its trigger, so it never runs backwards).
    A second counts them in state keyed by batch, a few bytes each: a batch is released when it has a record
    for every known pair and day, or when ``patience_seconds`` have passed without a piece of it by the clock
    of the arrivals. Released batches are read back from the table and go through the same contracts, so an
    expired one is refused with what it lacks. A piece that comes after the release goes to the quarantine with
    reason ``after_release``. A file outside any ``batch=`` folder only moves the clock on, which lets a quiet
    stream expire. Both streams resume from their checkpoints; a replay writes over its own folders.
    """
    hist = history.select("date", "store_nbr", "family", "sales")
    expected = hist.select("store_nbr", "family").distinct().count() * S.FORECAST_HORIZON_DAYS
    landed = f"{work_dir}/landed"
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pieces = reader.text(input_dir).select(
        F.col("value").alias("record"), F.current_timestamp().alias("arrived"), _batch_key().alias("batch")
    )
    land = (
        pieces.writeStream.format("parquet").partitionBy("batch").option("path", landed)
        .option("checkpointLocation", f"{work_dir}/checkpoint-land").trigger(availableNow=True).start()
    )
    land.awaitTermination()
    counted = spark.readStream.schema("arrived timestamp, batch string").parquet(landed)
    released = counted.withWatermark("arrived", "0 seconds").groupBy("batch").applyInPandasWithState(
        _assemble(expected, patience_seconds * 1000), _RELEASE, _ASSEMBLY, "append", GroupStateTimeout.EventTimeTimeout
    )

    def score(events: DataFrame, batch_id: int) -> None:
        events = materialize(events.where("batch <> ''"), "released")
        table = spark.read.schema("record string, arrived timestamp, batch string").parquet(landed)
        held = table.join(events.select("batch", "outcome", "after", "upto"), "batch")
        # Times of state are whole milliseconds.
        came = F.date_trunc("millisecond", "arrived")
        held = held.where((came > F.col("after")) & (came <= F.col("upto"))).select("record", "batch", "outcome")
        late = held.where("outcome = 'late'").select("record", "batch", F.lit("after_release").alias("reason"))
        late.write.mode("overwrite").parquet(f"{work_dir}/quarantine/late/batch_id={batch_id}")
        _score_records(
            held.where("outcome <> 'late'").select("record", "batch"), batch_id, bundle, hist,
            f"{work_dir}/out", f"{work_dir}/quarantine/refused",
        )

    q = (
        released.writeStream.outputMode("append").foreachBatch(score)
        .option("checkpointLocation", f"{work_dir}/checkpoint-score").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return work_dir


def batch_reasons(records: DataFrame, valid: DataFrame, history: DataFrame, cutoff: dt.date) -> DataFrame:
    """(batch, reason) of every batch to refuse: one row for each batch that breaks the record, window or
    pair contract, all found by grouping over the batch key."""
    sizes = records.groupBy("batch").agg(F.count(F.lit(1)).alias("records"))
    rules = {name: count_if(bad).alias(name) for name, bad in G.window_row_rules(cutoff).items()}
    first, last = cutoff + dt.timedelta(days=1), cutoff + dt.timedelta(days=S.FORECAST_HORIZON_DAYS)
    rows = valid.groupBy("batch").agg(
        F.count(F.lit(1)).alias("valid"),
        *rules.values(),
        F.count_distinct("id").alias("ids"),
        F.count_distinct(*[F.col(k) for k in S.BASE_KEY]).alias("keys"),
        F.count_distinct(F.when(F.col("date").between(F.lit(first), F.lit(last)), F.col("date"))).alias("days"),
    )
    pairs = valid.groupBy("batch", "store_nbr", "family").agg(F.count_distinct("date").alias("days"))
    known = history.select("store_nbr", "family").distinct().withColumn("known", F.lit(1))
    pairs = pairs.join(known, ["store_nbr", "family"], "left").groupBy("batch").agg(
        count_if(F.col("days") != S.FORECAST_HORIZON_DAYS).alias("incomplete"),
        F.count(F.lit(1)).alias("pairs"),
        F.count("known").alias("known"),
    )
    expected = known.agg(F.count(F.lit(1)).alias("expected"))
    facts = sizes.join(rows, "batch", "left").join(pairs, "batch", "left").join(F.broadcast(expected))  # one row
    window = [F.when(F.col(name) > 0, F.lit(name)) for name in rules]
    window += [
        F.when(F.col("ids") < F.col("valid"), F.lit("duplicate_id")),
        F.when(F.col("keys") < F.col("valid"), F.lit("duplicate_base_key")),
        F.when(F.col("days") < S.FORECAST_HORIZON_DAYS, F.lit("missing_window_dates")),
        F.when(F.col("incomplete") > 0, F.lit("incomplete_pairs")),
    ]
    broken = F.array_sort(F.array_compact(F.array(*window)))
    reason = (
        F.when(F.coalesce("valid", F.lit(0)) < F.col("records"), F.lit("record_contract"))
        .when(F.size(broken) > 0, F.concat(F.lit("window:"), F.concat_ws(",", broken)))
        .when((F.col("known") < F.col("pairs")) | (F.col("known") < F.col("expected")), F.lit("pair_coverage"))
    )
    return facts.select("batch", reason.alias("reason")).where("reason IS NOT NULL")


__all__ = ["RollupRun", "run_rollup_stream", "latest_rollup", "run_scoring_stream", "run_piecewise_scoring_stream"]
