"""Service state: last write wins per instance, then totals across instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import minus_seconds
from tidemark.schemas import INGEST_STATE, PROCESSOR_STATE, QUERY_STATE

STALE_AFTER_SECONDS = 15
INGEST, PROCESSOR, QUERY = "ingest-service", "stream-processor", "query-service"
_SCHEMAS = {INGEST: INGEST_STATE, PROCESSOR: PROCESSOR_STATE, QUERY: QUERY_STATE}

_SUMS = ("processed_total", "duplicate_total", "late_event_total", "dead_letter_total", "consumer_lag",
         "active_partitions", "inflight_messages")
_PEAKS = ("processing_p50_ms", "processing_p95_ms", "processing_p99_ms", "batch_size_p95", "batch_flush_p95_ms")


def latest_state(rows: DataFrame) -> DataFrame:
    """Upsert by (service, instance): the newest payload."""
    return rows.groupBy("service_name", "instance_id").agg(
        F.max_by("payload", "updated_at").alias("payload"), F.max("updated_at").alias("updated_at")
    )


def live_states(latest: DataFrame, service: str, as_of: Column, stale_after: float = STALE_AFTER_SECONDS) -> DataFrame:
    """Typed states of one service updated recently; ``updated_at`` replaces last seen."""
    typed = latest.where(
        (F.col("service_name") == service) & (F.col("updated_at") >= minus_seconds(as_of, stale_after))
    ).withColumn("state", F.from_json("payload", _SCHEMAS[service], {"mode": "PERMISSIVE"}))
    return typed.select(
        "service_name", "instance_id", "updated_at",
        F.col("state").withField("last_seen_at", F.col("updated_at")).alias("state"),
    )


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def ingest_state(states: DataFrame) -> DataFrame:
    """Sum of totals, newest last-seen; one row even with no instance."""
    return states.agg(
        _zero(F.sum("state.accepted_total")).alias("accepted_total"),
        _zero(F.sum("state.rejected_total")).alias("rejected_total"),
        F.max("state.last_seen_at").alias("last_seen_at"),
    )


def processor_state(states: DataFrame) -> DataFrame:
    """Totals add up, percentiles take the worst replica."""
    return states.agg(
        F.count(F.lit(1)).alias("instance_count"),
        *[_zero(F.sum(f"state.{c}")).alias(c) for c in _SUMS],
        *[F.coalesce(F.max(f"state.{c}"), F.lit(0.0)).alias(c) for c in _PEAKS],
        F.max("state.last_seen_at").alias("last_seen_at"),
    )


def partition_health(states: DataFrame) -> DataFrame:
    """One row per (owner, partition); a repeated entry keeps the last listed."""
    rows = states.select("instance_id", F.posexplode("state.partitions").alias("pos", "p"))
    last = rows.groupBy("instance_id", F.col("p.partition").alias("partition")).agg(
        F.max_by("p", "pos").alias("p")
    )
    fields = [f for f in last.schema["p"].dataType.fieldNames() if f not in ("partition", "owner_instance_id")]
    return last.select(
        "partition", F.col("instance_id").alias("owner_instance_id"), *[F.col(f"p.{f}").alias(f) for f in fields]
    )


def hottest_partitions(health: DataFrame, k: int = 6) -> DataFrame:
    return health.orderBy(F.desc("lag"), "partition", "owner_instance_id").limit(k)


def freshness_class(last_seen: Column, as_of: Column) -> Column:
    """healthy up to 15 s, stale up to 60 s, then offline; unknown when never seen."""
    micros = F.unix_micros(as_of) - F.unix_micros(last_seen)
    seconds = F.greatest(F.lit(0), F.floor(micros / 1_000_000 + F.lit(0.5)))
    return (
        F.when(last_seen.isNull(), "unknown").when(seconds <= 15, "healthy")
        .when(seconds <= 60, "stale").otherwise("offline")
    )


def system_status(lag: Column, error_rate: Column, max_lag: int = 50_000, max_error_rate: float = 0.05) -> Column:
    return F.when((lag > max_lag) | (error_rate > max_error_rate), "Pressure").otherwise("Nominal")


def processed_percent(processed: Column, accepted: Column) -> Column:
    """Processed against accepted, capped at 100; 0 when nothing was accepted."""
    return F.when(accepted > 0, F.least(F.lit(100.0), processed / accepted * 100)).otherwise(F.lit(0.0))
