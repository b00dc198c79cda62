"""Apply one batch of log rows to the hot views, exactly once.

Stream batches, replays and rebuilds all go through :func:`apply_batch`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.deadletters import to_dead_letters
from tidemark.operators.decode import accepted, classify
from tidemark.operators.dispositions import with_lag
from tidemark.operators.lateness import ALLOWED_LATENESS_SECONDS, OFFSETS_PER_BLOCK, partition_marks
from tidemark.operators.quantiles import rolling_quantiles
from tidemark.operators.state import PROCESSOR
from tidemark.plans.process import process_batch, view_deltas
from tidemark.sources.views import HotViews

LOG_COLUMNS = ("topic", "partition", "offset", "log_time")
TOTALS = ("processed_total", "duplicate_total", "late_event_total")
USED = ("event_id", "tenant_id", "source_id", "timestamp", "value", "status")
# rows that a batch adds to each view, as its statistics name them
WRITTEN = {
    "processed_events": "claim_rows", "tenant_metric_shards": "tenant_rows", "source_metrics": "source_rows", "event_windows": "window_rows"}
# topics of replay runs start with this; they are no part of the live log
REPLAY_TOPIC = "archive.replay"
EndOffsets = Callable[[], DataFrame]


@dataclass(frozen=True)
class BatchOptions:
    consumer_group: str = "telemetry-processor"
    instance_id: str = "processor-0"
    lateness_seconds: float = ALLOWED_LATENESS_SECONDS
    block: int = OFFSETS_PER_BLOCK
    ties: tuple[str, ...] = ()
    # seconds between service-state snapshots; None writes none
    snapshot_seconds: float | None = 5.0


@dataclass(frozen=True)
class BatchResult:
    recorded: int = 0
    duplicate: int = 0
    late: int = 0
    dead_letters: int = 0
    applied: bool = True


class _Clock:
    """Durations of a batch's stages, and the metrics observed on their writes."""

    def __init__(self) -> None:
        self.started = time.monotonic()
        self.ms: dict[str, float] = {}
        self.observed: dict[str, Observation] = {}

    def watch(self, view: str, df: DataFrame, *metrics: Column) -> DataFrame:
        """``df`` with metrics that its own write job takes along; without any, its rows are counted."""
        self.observed[view] = Observation()
        return df.observe(self.observed[view], *(metrics or (F.count(F.lit(1)).alias("rows"),)))

    def seen(self, view: str, metric: str = "rows") -> int:
        """An observed metric, once the write is done."""
        return self.observed[view].get[metric] or 0

    def timed(self, stage: str, job: Callable[[], None]) -> None:
        start = time.monotonic()
        job()
        self.ms[stage] = (time.monotonic() - start) * 1000

    @property
    def total(self) -> float:
        return (time.monotonic() - self.started) * 1000


def _together(*jobs: Callable[[], None]) -> None:
    """Run independent writes as concurrent Spark jobs; the first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def apply_messages(
    views: HotViews, messages: DataFrame, run_id: str, batch_id: int, options: BatchOptions = BatchOptions(),
    publish_dead_letters=None, fault=None, end_offsets: EndOffsets | None = None,
) -> BatchResult:
    """Decode Kafka-shaped messages, set bad ones aside, apply the rest."""
    if views.committed(run_id) >= batch_id:
        return BatchResult(applied=False)
    tagged, clock = classify(messages).persist(StorageLevel.MEMORY_AND_DISK), _Clock()
    try:
        letters = to_dead_letters(tagged.where("reason IS NOT NULL"), options.consumer_group)
        views.write("dead_letters", clock.watch("dead_letters", letters), run_id, batch_id)
        dead = clock.seen("dead_letters")
        if publish_dead_letters is not None and dead:
            publish_dead_letters(letters, batch_id)
        return apply_batch(views, accepted(tagged, LOG_COLUMNS), run_id, batch_id, options, dead, fault, end_offsets)
    finally:
        tagged.unpersist()


def apply_batch(
    views: HotViews, log: DataFrame, run_id: str, batch_id: int, options: BatchOptions = BatchOptions(),
    dead_letters: int = 0, fault=None, end_offsets: EndOffsets | None = None,
) -> BatchResult:
    """Claim, mark late, fold and write all views of a batch, then commit it.

    Its statistics are observed on the write jobs and are one row of ``batch_stats``, committed with the batch.

    A batch that is already committed is skipped. A batch that failed half way left only
    invisible folders, which the repetition overwrites. ``end_offsets()`` gives the log's ends
    as (topic, partition, end_offset) for the lag in state snapshots; without it the lag is 0.
    ``fault(stage)`` lets tests fail a stage.
    """
    if views.committed(run_id) >= batch_id:
        return BatchResult(applied=False)
    hit = fault or (lambda stage: None)
    clock, newest = _Clock(), []
    cached: list[DataFrame] = []

    def cache(df: DataFrame) -> DataFrame:
        cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return cached[-1]

    try:
        ties = [c for c in options.ties if c not in USED + LOG_COLUMNS]
        log = log.select(*USED, *LOG_COLUMNS, *ties)  # what is cached below holds no more than that
        ids = cache(log.select("event_id").distinct())
        ids.count()  # materialised, so its size is known when the join is planned
        processed = process_batch(
            log, views.claimed_among(ids), views.read("partition_marks"),
            options.lateness_seconds, options.block, options.ties,
        )
        winners = cache(processed.winners)
        claims = winners.select(
            "event_id", "tenant_id", F.current_timestamp().alias("processed_at"), views.claim_bucket().alias("bucket"))
        grain = cache(processed.grain)
        progress = cache(processed.progress)
        deltas = view_deltas(grain)

        def write_minutes() -> None:
            hit("overview_minutes")
            newest.append(views.write_minutes(grain, run_id, batch_id))

        def write(view: str, df: DataFrame, stage: str, *metrics: Column) -> Callable[[], None]:
            def job() -> None:
                hit(view)
                views.write(view, clock.watch(view, df, *metrics), run_id, batch_id)
            return lambda: clock.timed(stage, job)

        # the claims write fills the cache every other write reads
        write("processed_events", claims, "dedup_claim_ms")()
        _together(
            write("tenant_metric_shards", deltas["tenant_metric_shards"], "tenant_aggregate_ms"),
            write("source_metrics", deltas["source_metrics"], "source_aggregate_ms"),
            write("event_windows", deltas["event_windows"], "window_aggregate_ms"),
            write("partition_marks", partition_marks(log), "marks_ms"),
            write("partition_progress", progress, "commit_ms", *(F.sum(c).alias(c) for c in TOTALS)),
            write_minutes,
        )
        recorded, duplicate, late = (clock.seen("partition_progress", c) for c in TOTALS)
        result = BatchResult(recorded, duplicate, late, dead_letters)
        _write_stats(views, run_id, batch_id, options, result, clock)
        if views.snapshot_due(options.snapshot_seconds):
            views.write("service_state", _snapshot(views, run_id, batch_id, options.instance_id, end_offsets), run_id, batch_id)
        hit("commit")
        views.commit(run_id, batch_id)
        views.advance_overview(run_id, batch_id, newest[0])
        return result
    finally:
        for df in cached:
            df.unpersist()


def _write_stats(views: HotViews, run_id: str, batch_id: int, options: BatchOptions, r: BatchResult, clock: _Clock) -> None:
    size, flush = r.recorded + r.duplicate + r.late, clock.total
    row = {
        "instance_id": options.instance_id, "batch_size": size, "recorded_count": r.recorded,
        "duplicate_count": r.duplicate, "late_count": r.late, "dead_letter_count": r.dead_letters, "flush_ms": flush,
        "per_recorded_ms": flush / r.recorded if r.recorded else None,
        **{k: v for k, v in clock.ms.items() if k != "marks_ms"},
        **{name: clock.seen(view) for view, name in WRITTEN.items()},
    }
    names = ", ".join(f"{k} {'string' if k == 'instance_id' else 'bigint' if k.endswith(('count', 'size', 'rows')) else 'double'}" for k in row)
    stats = views.spark.createDataFrame([tuple(row.values())], names).withColumn("flushed_at", F.current_timestamp())
    views.write("batch_stats", stats, run_id, batch_id)


def _snapshot(views: HotViews, run_id: str, batch_id: int, instance: str, end_offsets: EndOffsets | None) -> DataFrame:
    """Processor state of this instance: totals, partitions and rolling quantiles.

    Reads the small progress and stats views, the current batch's folders included.
    """
    def with_current(view: str) -> DataFrame:
        now = views.spark.read.parquet(f"{views.root}/{view}/run_id={run_id}/batch_id={batch_id}")
        return views.deltas(view).drop("run_id", "batch_id").unionByName(now)

    stats = with_current("batch_stats").where(F.col("instance_id") == instance)
    live = ~F.col("topic").startswith(REPLAY_TOPIC)
    parts = with_current("partition_progress").where(live).groupBy("topic", "partition").agg(
        *[F.sum(c).alias(c) for c in TOTALS],
        F.max("last_offset").alias("last_offset"), F.max("last_seen_at").alias("last_seen_at"))
    zero = F.lit(0).cast("bigint")
    parts = with_lag(parts, end_offsets()) if end_offsets else parts.withColumns({"lag": zero, "inflight_messages": zero})
    listed = parts.agg(
        F.sum("lag").alias("consumer_lag"), F.sum("inflight_messages").alias("inflight_messages"),
        *[F.sum(c).alias(c) for c in TOTALS],
        F.count(F.lit(1)).alias("active_partitions"),
        F.sort_array(F.collect_list(F.struct(
            "partition", F.lit(instance).alias("owner_instance_id"), "lag", "processed_total",
            "duplicate_total", "late_event_total", "inflight_messages", "last_offset", "last_seen_at",
        ))).alias("partitions"),
    )
    quantiles = [
        _window(stats, "per_recorded_ms", 4096, "processing", "_ms"),
        _window(stats, "batch_size", 2048, "batch_size", ""),
        _window(stats, "flush_ms", 2048, "batch_flush", "_ms"),
        stats.agg(F.sum("dead_letter_count").alias("dead_letter_total"),
                  F.unix_seconds(F.current_timestamp()).alias("__now"), F.min("flushed_at").alias("__first")),
    ]
    stacked = listed
    for q in quantiles:
        stacked = stacked.unionByName(q, allowMissingColumns=True)
    row = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    state: list[Column | str] = [
        "processed_total", "duplicate_total", "late_event_total", "dead_letter_total",
        "consumer_lag", "active_partitions", "inflight_messages",
        (F.col("__now") - F.unix_seconds("__first")).alias("uptime_seconds"),
        *[f"{k}_p{q}{u}" for k, u in (("processing", "_ms"), ("batch_size", ""), ("batch_flush", "_ms")) for q in (50, 95, 99)],
        "partitions",
    ]
    return row.select(
        F.lit(PROCESSOR).alias("service_name"), F.lit(instance).alias("instance_id"),
        F.to_json(F.struct(*state)).alias("payload"), F.current_timestamp().alias("updated_at"),
    )


def _window(stats: DataFrame, value: str, n: int, name: str, unit: str) -> DataFrame:
    observed = stats.where(F.col(value).isNotNull()).withColumn("v", F.floor(F.col(value)).cast("double"))
    q = rolling_quantiles(observed, [], ["flushed_at"], "v", n)
    return q.select(*[F.col(f"p{p}").alias(f"{name}_p{p}{unit}") for p in (50, 95, 99)])
