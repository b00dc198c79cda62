"""The read queries. ``as_of`` stands for "now" and is always explicit.

Queries that add up their input (rates, totals, series, tenant windows) give the same
answer over merged views and over unmerged deltas; the latter saves a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import safe_ratio
from tidemark.functions.text import null_to_empty
from tidemark.functions.timeparts import duration_label, duration_seconds, millis_between, minus_seconds, window_label
from tidemark.operators.admission import ADMIN, Principal
from tidemark.operators.aggregates import WINDOW_SECONDS, tenant_rollup
from tidemark.operators.lateness import ALLOWED_LATENESS_SECONDS
from tidemark.operators.state import INGEST, PROCESSOR, ingest_state, live_states, partition_health, processor_state
from tidemark.plans.scope import requested_tenant, require_admin, scoped

ANYONE = Principal(ADMIN)


def _positive_limit(limit: int) -> int:
    if limit <= 0:
        raise ValueError("invalid limit")
    return limit


def overview_rates(shards: DataFrame, legacy: DataFrame | None, as_of: Column, principal: Principal = ANYONE) -> DataFrame:
    """Rate and error share of the last minute's buckets; one row, zeros when empty."""
    columns = ["bucket_start", "tenant_id", "events_count", "error_count"]
    rows = scoped(shards, principal).select(*columns)
    if legacy is not None:
        rows = rows.unionByName(scoped(legacy, principal).select(*columns))
    recent = rows.where(F.col("bucket_start") >= minus_seconds(as_of, 60))
    zero = F.lit(0).cast("bigint")
    totals = recent.agg(
        F.coalesce(F.sum("events_count"), zero).alias("events"), F.coalesce(F.sum("error_count"), zero).alias("errors")
    )
    return totals.select(
        (F.col("events") / 60.0).alias("events_per_second_last_minute"),
        safe_ratio("errors", "events").alias("error_rate_last_minute"),
    )


def processed_total(sources: DataFrame, principal: Principal = ANYONE) -> DataFrame:
    return scoped(sources, principal).agg(
        F.coalesce(F.sum("events_count"), F.lit(0).cast("bigint")).alias("stored_processed_total")
    )


def tenant_series(
    shards: DataFrame, legacy: DataFrame | None, tenant_id: str, as_of: Column, window: str | None = None,
    principal: Principal = ANYONE,
) -> DataFrame:
    """10 s buckets of one tenant in the look-back window, ascending."""
    tenant = requested_tenant(principal, tenant_id)
    since = minus_seconds(as_of, duration_seconds(window, "15m", positive=False))

    def cut(df: DataFrame) -> DataFrame:
        return scoped(df, principal).where((F.col("tenant_id") == tenant) & (F.col("bucket_start") >= since))

    merged = tenant_rollup(cut(shards), None if legacy is None else cut(legacy))
    return merged.select(
        "bucket_start", "events_count", "ok_count", "warn_count", "error_count",
        safe_ratio("value_sum", "events_count").alias("average_value"),
    ).orderBy("bucket_start")


def event_windows(
    windows: DataFrame, tenant_id: str | None, as_of: Column, source_id: str | None = None,
    window_size: str | None = None, lookback: str | None = None, principal: Principal = ANYONE,
) -> DataFrame:
    """Windows of one size for a tenant (all sources merged) or one of its sources.

    A size that is not kept yields no rows.
    """
    tenant = requested_tenant(principal, tenant_id)
    size = int(duration_seconds(window_size, "1m"))
    since = minus_seconds(as_of, duration_seconds(lookback, "15m"))
    rows = scoped(windows, principal).where(
        (F.col("tenant_id") == tenant) & (F.col("window_size_seconds") == size) & (F.col("window_start") >= since)
    )
    source = (source_id or "").strip()
    if source:
        rows = rows.where(F.col("source_id") == source)
    else:
        rows = all_sources(rows)
    return rows.select(*window_columns(as_of)).orderBy("window_start")


def all_sources(windows: DataFrame) -> DataFrame:
    """Merge the sources of each tenant window; the source becomes ''."""
    counts = ["events_count", "ok_count", "warn_count", "error_count"]
    return windows.groupBy("window_size_seconds", "window_start", "tenant_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("value_sum").alias("value_sum"),
        F.max("max_event_at").alias("max_event_at"),
    ).withColumn("source_id", F.lit(""))


def window_columns(as_of: Column) -> list[Column]:
    return [
        F.col("window_start"), window_label("window_size_seconds").alias("window_size"),
        F.col("tenant_id"), F.col("source_id"),
        F.col("events_count"), F.col("ok_count"), F.col("warn_count"), F.col("error_count"),
        safe_ratio("value_sum", "events_count").alias("average_value"), F.col("max_event_at"),
        millis_between(as_of, "max_event_at").alias("freshness_ms"),
    ]


def top_sources(
    sources: DataFrame, tenant_id: str | None = None, limit: int = 10, principal: Principal = ANYONE,
) -> DataFrame:
    """Busiest sources; ties go to the more recent, then by name. Each task keeps ``limit`` rows."""
    tenant = requested_tenant(principal, tenant_id, required=False)
    rows = scoped(sources, principal)
    if tenant:
        rows = rows.where(F.col("tenant_id") == tenant)
    return rows.select("tenant_id", "source_id", F.col("events_count").alias("events"), "last_event_at").orderBy(
        F.desc("events"), F.desc("last_event_at"), "tenant_id", "source_id"
    ).limit(_positive_limit(limit))


def recent_rejections(rejections: DataFrame, limit: int = 10, principal: Principal = ANYONE) -> DataFrame:
    return scoped(rejections, principal).select(
        "id", "reason", null_to_empty("tenant_id").alias("tenant_id"), null_to_empty("source_id").alias("source_id"),
        "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id")).limit(_positive_limit(limit))


def partitions(states: DataFrame, as_of: Column, principal: Principal = ANYONE) -> DataFrame:
    """Health of every partition by owner, for admins."""
    require_admin(principal)
    return partition_health(live_states(states, PROCESSOR, as_of)).orderBy("partition", "owner_instance_id")


def overview(
    shards: DataFrame, legacy: DataFrame | None, sources: DataFrame, rejections: DataFrame, states: DataFrame,
    as_of: Column, principal: Principal = ANYONE,
) -> DataFrame:
    """The dashboard's one row.

    Six one-row aggregates are stacked and folded to one row; the lists are the ten
    newest rejections and one entry per live partition.
    """
    ingest = ingest_state(live_states(scoped(states, principal), INGEST, as_of))
    live = live_states(scoped(states, principal), PROCESSOR, as_of)
    processor = processor_state(live)
    health = partition_health(live)
    health_list = health.agg(F.sort_array(F.collect_list(F.struct(
        "partition", "owner_instance_id", *[c for c in health.columns if c not in ("partition", "owner_instance_id")]
    ))).alias("partition_health"))
    newest = recent_rejections(rejections, 10, principal)
    newest_list = newest.agg(F.transform(
        F.sort_array(F.collect_list(F.struct("created_at", "id", "reason", "tenant_id", "source_id")), asc=False),
        lambda r: F.struct(r["id"].alias("id"), r["reason"].alias("reason"), r["tenant_id"].alias("tenant_id"),
                           r["source_id"].alias("source_id"), r["created_at"].alias("created_at")),
    ).alias("recent_rejections"))
    stored = processed_total(sources, principal)
    rates = overview_rates(shards, legacy, as_of, principal)

    ingest = ingest.select(
        "accepted_total", "rejected_total", F.col("last_seen_at").alias("ingest_last_seen_at")
    )
    processor = processor.select(
        F.col("processed_total").alias("processor_processed_total"), "duplicate_total",
        F.col("late_event_total"), "dead_letter_total", "consumer_lag",
        F.col("instance_count").alias("processor_instances"),
        F.col("active_partitions").alias("processor_active_partitions"),
        F.col("inflight_messages").alias("processor_inflight_messages"),
        "processing_p50_ms", "processing_p95_ms", "processing_p99_ms", "batch_size_p95", "batch_flush_p95_ms",
        F.col("last_seen_at").alias("processor_last_seen_at"),
    )
    parts = [rates, stored, ingest, processor, health_list, newest_list]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    # every column comes from exactly one one-row part
    row = stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
    return row.select(
        as_of.alias("generated_at"), "*",
        F.col("stored_processed_total").alias("processed_total"),
        F.array(*[F.lit(duration_label(s)) for s in WINDOW_SECONDS]).alias("window_sizes"),
        F.lit(duration_label(ALLOWED_LATENESS_SECONDS)).alias("allowed_lateness"),
    )
