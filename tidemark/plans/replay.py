"""Replay the archive, rebuild hot views from it, and judge the outcome."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import log_partition
from tidemark.functions.text import partition_key
from tidemark.operators.lateness import ALLOWED_LATENESS_SECONDS, OFFSETS_PER_BLOCK
from tidemark.plans.apply import REPLAY_TOPIC, BatchOptions, BatchResult, apply_batch
from tidemark.schemas import POSITION
from tidemark.sources.archive import day_range, read_archive
from tidemark.sources.events import to_log_rows, write_log
from tidemark.sources.views import HotViews

# A minute of arrivals per scan block.
REPLAY_BLOCK_US = 60_000_000
# Order of rows stamped alike that have no log offset
REPLAY_TIES = ("request", "pos", "event_id")
_REPLAY_ORDER = ("archived_at", "position.offset", "position.request", "position.pos", "event.event_id")


def _with_position(lines: DataFrame) -> DataFrame:
    return lines if "position" in lines.columns else lines.withColumn("position", F.lit(None).cast(POSITION))


def replay_filter(lines: DataFrame, tenant: str | None = None, limit: int = 0) -> DataFrame:
    """Decoded events to publish: the tenant's, in archive order, at most ``limit`` if set."""
    if limit < 0:
        raise ValueError("limit must be zero or greater")
    rows = _with_position(lines)
    if tenant and tenant.strip():
        rows = rows.where(F.col("event.tenant_id") == tenant.strip())
    if limit:
        rows = rows.orderBy("path", *_REPLAY_ORDER).limit(limit)
    return rows.select("archived_at", "event", "position")


def replay(spark, root: str, start: str, end: str | None = None, tenant: str | None = None, limit: int = 0) -> DataFrame:
    return replay_filter(read_archive(spark, root, start, end, tenant), tenant, limit)


def replay_summary(lines: DataFrame, tenant: str | None = None, limit: int = 0) -> DataFrame:
    """Files read, lines scanned, skipped and replayed.

    All lines of the range are counted, also when a limit would end a sequential scan.
    """
    wanted = F.lit(True) if not (tenant and tenant.strip()) else F.coalesce(
        F.col("event.tenant_id") == tenant.strip(), F.lit(False))
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(wanted).alias("hit"))
    zero = F.lit(0).cast("bigint")
    hits = F.coalesce(F.sum("hit"), zero)
    return files.agg(
        F.count(F.lit(1)).alias("files_read"), F.coalesce(F.sum("n"), zero).alias("scanned"),
        (F.coalesce(F.sum("n"), zero) - hits).alias("skipped"),
        (F.least(hits, F.lit(limit)) if limit else hits).alias("replayed"),
    )


def as_log(replayed: DataFrame, partitions: int, partition: Column | None = None, run_id: str = "") -> DataFrame:
    """Replayed events as log rows in their original arrival order.

    Each run is a log of its own, so marks left by another replay make nothing late. Lines archived from the log keep
    their partition, offset and log time. Others are ordered by archive time, and by request and position among those
    stamped alike (``REPLAY_TIES``); ``partition`` must send their sources where the live log sent them for lateness to
    come out the same; by default the key hash decides.
    """
    at = F.col("position")
    keyed = partition if partition is not None else log_partition(partition_key("event.tenant_id", "event.source_id"), partitions)
    return _with_position(replayed).select(
        "event.*", F.concat_ws(".", F.lit(f"{REPLAY_TOPIC}.{run_id}"), at["topic"]).alias("topic"),
        F.coalesce(at["partition"], keyed.cast("int")).alias("partition"),
        F.coalesce(at["offset"], F.unix_micros("archived_at")).alias("offset"),
        F.coalesce(at["log_time"], F.col("archived_at")).alias("log_time"), at["request"].alias("request"), at["pos"].alias("pos"),
    )


def republish(
    lines: DataFrame, fmt: str, options: Mapping[str, str] = {}, path: str | None = None, tenant: str | None = None, limit: int = 0,
) -> DataFrame:
    """Publish archived events to the log in their order, and give the accounting of ``replay_summary``.

    What shared a log partition is written by one task in log order; without a log position, so is a source.
    """
    rows = replay_filter(lines, tenant, limit)
    at, unplaced = F.col("position"), F.col("position.offset").isNull()
    together = [at["topic"], at["partition"], *[F.when(unplaced, F.col(f"event.{c}")) for c in ("tenant_id", "source_id")]]
    # within a log partition the offset decides; archive times of different batches may cross
    ordered = rows.repartition(*together).sortWithinPartitions("position.topic", "position.partition", "position.offset", *_REPLAY_ORDER)
    write_log(to_log_rows(ordered, F.col("event")), fmt, options, path)
    return replay_summary(lines, tenant, limit)


def rebuild(
    views: HotViews, archive_root: str, start: str, end: str | None, tenants: Sequence[str], run_id: str,
    partitions: int, partition: Column | None = None, lateness_seconds: float = ALLOWED_LATENESS_SECONDS, fault=None,
    block: int | None = None,
) -> BatchResult:
    """Replace the tenants' hot rows by what their archived events give.

    The reset and the rebuilt rows become visible in one commit; a failure before it changes
    nothing. A used ``run_id`` is refused, as its batch would be skipped, and so is a range that
    leaves out days for which the tenants have hot rows. Lateness is judged among the replayed
    rows, so it comes out as it was only when all tenants that share a log partition are rebuilt
    together. ``block`` is the number of offsets in a scan block, by default that of a dense log.
    """
    if views.committed(run_id) >= 0:
        raise ValueError(f"run id {run_id} is used already")
    first, last = day_range(start, end)
    held = views.read("tenant_metric_shards").where(F.col("tenant_id").isin(list(tenants))).agg(
        F.min("bucket_start").cast("date").alias("first"), F.max("bucket_start").cast("date").alias("last")).first()
    if held["first"] is not None and not first <= held["first"] <= held["last"] <= last:
        raise ValueError(f"the tenants have hot rows from {held['first']} to {held['last']}; rebuild all these days")
    lines = read_archive(views.spark, archive_root, start, end, tenants[0] if len(tenants) == 1 else None)
    wanted = lines.where(F.col("event.tenant_id").isin(list(tenants)))
    # parsed once, then read by the claims, marks and lateness passes
    log = as_log(wanted.select("archived_at", "event", "position"), partitions, partition, run_id).persist(StorageLevel.DISK_ONLY)
    try:
        if block is None:
            placed = not wanted.where("position.offset IS NOT NULL").isEmpty()
            block = OFFSETS_PER_BLOCK if placed else REPLAY_BLOCK_US
        options = BatchOptions(
            lateness_seconds=lateness_seconds, block=block, ties=REPLAY_TIES, instance_id=run_id, snapshot_seconds=None)
        result = apply_batch(views.as_if_reset(tenants), log, run_id, 0, options, fault=fault)
        views.forget_minutes(tenants, but_run=run_id)
        return result
    finally:
        log.unpersist()
        views.refresh()


def hot_totals(views: HotViews, tenant: str | None = None) -> DataFrame:
    """One row: claimed ids and counted events, for before/after comparison."""
    claims, sources = views.read("processed_events"), views.read("source_metrics")
    if tenant:
        claims, sources = (d.where(F.col("tenant_id") == tenant) for d in (claims, sources))
    zero = F.lit(0).cast("bigint")
    parts = claims.agg(F.count(F.lit(1)).alias("processed_events")).unionByName(
        sources.agg(F.coalesce(F.sum("events_count"), zero).alias("source_events")), allowMissingColumns=True)
    return parts.agg(F.max("processed_events").alias("processed_events"), F.max("source_events").alias("source_events"))


def _tag(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _side_by_side(**rows: DataFrame) -> DataFrame:
    """One-row frames as the columns of one row."""
    tagged = [_tag(df, name) for name, df in rows.items()]
    stacked = tagged[0]
    for part in tagged[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def replay_verdict(before: DataFrame, after: DataFrame, replayed: int, duplicates: int) -> DataFrame:
    """Replaying processed events must change nothing: ``before``/``after`` are hot totals."""
    row = _side_by_side(before=before, after=after)
    over = F.col("after_source_events") - F.col("before_source_events")
    claims = F.col("after_processed_events") - F.col("before_processed_events")
    return row.select(
        over.alias("source_metric_overcount_delta"), claims.alias("processed_events_delta"),
        ((over == 0) & (claims == 0) & (F.lit(duplicates) >= F.lit(replayed))).alias("duplicate_safe"),
    )


def rebuild_verdict(after_reset: DataFrame, after_rebuild: DataFrame, expected: int) -> DataFrame:
    """Zero after the reset, the expected count after the rebuild."""
    row = _side_by_side(reset=after_reset, rebuild=after_rebuild)
    return row.select(
        ((F.col("reset_processed_events") == 0) & (F.col("reset_source_events") == 0)
         & (F.col("rebuild_processed_events") == expected) & (F.col("rebuild_source_events") == expected))
        .alias("rebuild_restored")
    )
