"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "event_windows_all_tenants", "event_windows", "tenant_shards", "source_metrics", "disposition_totals",
    "partition_progress", "dedup_claims", "late_events", "overview_rates", "tenant_series", "event_windows_tenant",
    "top_sources", "validate_reasons", "dead_letters", "admitted_rows", "published_log", "replay_totals",
    "nearest_rank_percentiles", "rolling_quantiles", "counter_increase", "histogram_quantile", "lag_alerts",
)
# Read queries over stored views, as an API would run them
READ_RUNS = 20
MICRO_ROWS = 1_000


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def main() -> None:
    from pyspark.sql import functions as F

    from tidemark import fixtures as fx
    from tidemark.plans import queries as q
    from tidemark.functions.text import encode_event, event_struct
    from tidemark.operators.admission import ADMIN, Principal
    from tidemark.plans.apply import BatchOptions, apply_batch, apply_messages
    from tidemark.plans.reader import Reader
    from tidemark.schemas import LOG_MESSAGE
    from tidemark.session import local_session
    from tidemark.sources.views import HotViews
    from tidemark.workload import QUERIES, TENANT

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    drain(QUERIES["event_windows_all_tenants"](spark, sf_dir))  # start-up and code generation
    times = {name: round(min(timed(lambda: drain(QUERIES[name](spark, sf_dir))) for _ in range(2)), 3) for name in HEADLINE}

    # the whole write path: claims, lateness, three aggregates, marks, commit
    views = HotViews(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), claim_buckets=8)
    options = BatchOptions(block=fx.OFFSET_BLOCK, snapshot_seconds=None)
    log = fx.telemetry(spark, sf_dir)
    rows = log.count()
    apply_batch(views, log.where("partition = 0"), "warm", 0, options)
    views = HotViews(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), claim_buckets=8)
    times["apply_batch"] = round(timed(lambda: apply_batch(views, log, "run", 0, options)), 3)

    # both queries add up, so they read the deltas unmerged
    shards, now = views.deltas("tenant_metric_shards"), F.lit("2024-01-01 12:00:00").cast("timestamp")
    reads = sorted(timed(lambda: q.overview_rates(shards, None, now).collect()) for _ in range(READ_RUNS))
    series = sorted(timed(lambda: q.tenant_series(shards, None, TENANT, now, "12h").collect()) for _ in range(READ_RUNS))

    # a small micro-batch as a stream applies it: decode, dead letters, snapshot, default claim buckets, a filled claim table
    views = HotViews(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    apply_batch(views, log, "run", 0, options)
    fresh = log.where("copy_no = 0").limit(MICRO_ROWS).withColumn("event_id", F.concat(F.lit("new-"), "event_id"))
    messages = fresh.withColumn("text", encode_event(event_struct())).select(
        F.col("tenant_id").cast("binary").alias("key"), F.col("text").cast("binary").alias("value"), "topic", "partition",
        "offset", "log_time", F.array().cast(LOG_MESSAGE["headers"].dataType).alias("headers"))
    live = BatchOptions(block=fx.OFFSET_BLOCK, snapshot_seconds=0)
    times["micro_batch"] = min(round(timed(lambda: apply_messages(views, messages, "run", at, live)), 3) for at in (1, 2, 3))
    reader = Reader(views)
    noon = dt.datetime(2024, 1, 1, 12, tzinfo=dt.UTC)
    whole = sorted(timed(lambda: reader.overview(Principal(ADMIN), noon).collect()) for _ in range(READ_RUNS))
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name, "log_rows": rows, "apply_rows_per_second": round(rows / times["apply_batch"]),
        "overview_ms": round(whole[READ_RUNS // 2] * 1000, 1), "overview_p95_ms": round(whole[int(0.95 * (READ_RUNS - 1))] * 1000, 1), "micro_batch_rows": MICRO_ROWS, "overview_rates_p95_ms": round(reads[int(0.95 * (READ_RUNS - 1))] * 1000, 1),
        "tenant_series_p95_ms": round(series[int(0.95 * (READ_RUNS - 1))] * 1000, 1),
    }))


if __name__ == "__main__":
    main()
