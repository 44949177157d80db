"""Structured Streaming: windowed request rollup (update mode) equals the batch rollup."""

import datetime as dt

from pyspark.sql import functions as F

from shelfcast.session import new_output_path
from shelfcast.streaming import jobs as SJ
from shelfcast.streaming import requests as RQ

LOG_SCHEMA = ("event string, timestamp_utc timestamp, request_id string, method string, path string, "
              "status_code int, latency_ms double, row_count long")


def test_rollup_stream_matches_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 0, 30)
    rows = [
        ("http_request", base + dt.timedelta(hours=7 * i), str(i), "POST",
         ["/forecast", "/health", "/metrics", "/x"][i % 4], [200, 422, 401, 200][i % 4], float(i % 13) + 0.25, 16)
        for i in range(40)
    ]
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    daily = RQ.with_outcome(log).groupBy(F.to_date("timestamp_utc").alias("d"), F.col("known_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_ms").alias("mx"))
    exp = {(r.d, r.path): (r.n, r.mx) for r in daily.collect()}
    rid = F.col("request_id").cast("int")

    def run(name, chunk, watermark):
        src = str(tmp_path / name)
        for k in range(3):  # three arriving files, one micro-batch each
            log.filter(chunk == k).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = new_output_path(spark, name)
        late = SJ.run_rollup_stream(spark, stream, out, new_output_path(spark, name + "_ckpt"), watermark=watermark).late
        return late, {(r.window_start.date(), r.path): (r.request_count, r.maximum_ms)
                      for r in SJ.latest_rollup(spark, out).collect()}

    # files rotate in time order: a tight watermark loses nothing
    assert run("in_order", F.floor(rid * 3 / 40), "1 hour") == (0, exp)
    # out-of-order files: windows still inside the watermark delay are updated
    assert run("out_of_order", rid % 3, "30 days") == (0, exp)
    # with a tight watermark they can't be, and the run says so
    late, found = run("too_late", rid % 3, "1 hour")
    assert late > 0 and found != exp
