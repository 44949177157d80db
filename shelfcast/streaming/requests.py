"""Scoring-service request log: outcome classification (R2), rollups (R1),
post-run expectations (R4); batch and Structured Streaming versions.

The log is one JSON record per request (event, timestamp_utc, request_id,
method, path, status_code, latency_ms, row_count). Counters are partial
aggregates per key, so a hot path collapses map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast import schemas as S
from shelfcast.functions.columns import count_if

MS = "decimal(28,6)"


def known_path(path: Column) -> Column:
    return F.when(path.isin(*S.KNOWN_PATHS), path).otherwise(F.lit("other"))


def outcome(path: Column, status: Column, rows: Column) -> Column:
    """R2: forecast outcome from status + received rows; NULL for non-forecast paths."""
    o = (
        F.when((status == 422) & (F.coalesce(rows, F.lit(0)) == 0), "schema_rejection")
        .when(status == 422, "contract_rejection")
        .when(status.isin(401, 403), "authentication_rejection")
        .when(status == 503, "service_unavailable")
        .when(status >= 500, "model_error")
        .when((status >= 200) & (status < 300), "success")
        .otherwise("other_response")
    )
    return F.when(path == "/forecast", o)


def with_outcome(log: DataFrame) -> DataFrame:
    return log.withColumns({
        "known_path": known_path(F.col("path")),
        "forecast_outcome": outcome(F.col("path"), F.col("status_code"), F.col("row_count")),
    })


def _latency_aggs():
    return [
        F.count(F.lit(1)).alias("request_count"),
        (F.sum(F.col("latency_ms").cast(MS)).cast("double") / F.count(F.lit(1)).cast("double")).alias("average_ms"),
        F.max("latency_ms").alias("maximum_ms"),
    ]


def path_rollup(log: DataFrame) -> DataFrame:
    """Requests and latency per known path."""
    return with_outcome(log).groupBy(F.col("known_path").alias("path")).agg(*_latency_aggs())


def status_rollup(log: DataFrame) -> DataFrame:
    """Responses per status code."""
    return log.groupBy(F.col("status_code").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("responses"))


def outcome_rollup(log: DataFrame) -> DataFrame:
    """Forecast requests and received rows per outcome."""
    f = with_outcome(log).filter(F.col("known_path") == "/forecast")
    return f.groupBy("forecast_outcome").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("row_count").cast("long").alias("rows_received")
    )


def rollup_checks(log: DataFrame, successful_batch_rows: int = 1) -> DataFrame:
    """The post-run counter expectations, one (rule, violations) row each (0 = met)."""
    w = with_outcome(log)
    fc = F.col("known_path") == "/forecast"
    o = F.col("forecast_outcome")
    counts = w.agg(
        count_if(fc).alias("forecast_requests"),
        count_if(F.col("status_code") == 200).alias("status_200"),
        count_if(F.col("status_code") == 422).alias("status_422"),
        count_if(F.col("status_code") == 401).alias("status_401"),
        F.coalesce(F.sum(F.when(fc, F.col("row_count"))), F.lit(0)).cast("long").alias("rows_received"),
        count_if(o == "success").alias("success"),
        count_if(o == "contract_rejection").alias("contract_rejections"),
        count_if(o == "schema_rejection").alias("schema_rejections"),
        count_if(o == "authentication_rejection").alias("authentication_rejections"),
    )
    thresholds = {
        "forecast_requests": 4, "status_200": 1, "status_422": 2, "status_401": 1,
        "rows_received": successful_batch_rows + 1, "success": 1, "contract_rejections": 1,
        "schema_rejections": 1, "authentication_rejections": 1,
    }
    rows = F.explode(F.array(*[
        F.struct(F.lit(f"min_{k}").alias("rule"), F.when(F.col(k) < v, 1).otherwise(0).cast("long").alias("violations"))
        for k, v in thresholds.items()
    ])).alias("x")
    return counts.select(rows).select("x.*")


def path_rollup_stream(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """R1 streaming twin: per event-time window and known path (TIMESTAMP, not NTZ)."""
    w = with_outcome(stream).withWatermark("timestamp_utc", watermark)
    return w.groupBy(F.window("timestamp_utc", window).alias("w"), F.col("known_path").alias("path")).agg(*_latency_aggs())
