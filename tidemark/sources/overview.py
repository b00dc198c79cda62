"""The dashboard's roll-up: a table of minutes and a small current table, so that a read opens a few small files.

``overview_minutes/minute=<n>/run_id=<run>/batch_id=<b>`` holds what a batch adds to the 10 s buckets of a minute, by tenant,
for its newest ``KEPT_MINUTES`` minutes: a dashboard asks for the last one. A repeated batch overwrites its own partitions
and no other. ``overview_current/at=<commit>.<newest minute>`` holds, as of a commit, the stored total of each tenant, the newest
rejections and the newest state of each service instance; it is folded from the table one commit earlier and what the batch
added. The last-minute rates therefore open two minutes, whatever the history; a time before the kept minutes is answered
from the views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeparts import duration_label
from tidemark.operators.admission import ADMIN, SERVICE, Principal
from tidemark.operators.aggregates import WINDOW_SECONDS
from tidemark.operators.lateness import ALLOWED_LATENESS_SECONDS
from tidemark.operators.state import INGEST, PROCESSOR, STALE_AFTER_SECONDS
from tidemark.schemas import INGEST_STATE, PROCESSOR_STATE

MINUTES, CURRENT = "overview_minutes", "overview_current"
NEWEST = 10
MINUTE_US = 60_000_000
KEPT_MINUTES = 15

# kind: bucket, total, rejection (whole: among the newest of all tenants) or state
ROW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("at", T.TimestampType()), T.StructField("id", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("service_name", T.StringType()),
    T.StructField("events_count", T.LongType()), T.StructField("error_count", T.LongType()),
    T.StructField("ingest", INGEST_STATE), T.StructField("processor", PROCESSOR_STATE),
])


def _shaped(df: DataFrame) -> DataFrame:
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ROW.fields if f.name not in df.columns]
    return df.select("*", *missing).select(*[F.col(f.name).cast(f.dataType) for f in ROW.fields])


def minute_rows(grain: DataFrame) -> DataFrame:
    """(``ROW``, minute): events and errors by bucket and tenant of the newest minutes, with the number of the bucket's minute."""
    newest = F.unix_micros(grain.agg(F.max("bucket_start")).scalar())
    recent = grain.where(F.floor(F.unix_micros("bucket_start") / MINUTE_US) > F.floor(newest / MINUTE_US) - KEPT_MINUTES)
    by_bucket = recent.groupBy("bucket_start", "tenant_id").agg(
        F.sum("events_count").alias("events_count"), F.sum("error_count").alias("error_count"))
    rows = _shaped(by_bucket.select(F.lit("bucket").alias("kind"), F.col("bucket_start").alias("at"), "tenant_id", "events_count", "error_count"))
    return rows.withColumn("minute", F.floor(F.unix_micros("at") / MINUTE_US).cast("bigint"))


def total_rows(sources: DataFrame) -> DataFrame:
    totals = sources.groupBy("tenant_id").agg(F.sum("events_count").alias("events_count"))
    return _shaped(totals.withColumn("kind", F.lit("total")))


def rejection_rows(rejections: DataFrame) -> DataFrame:
    """Every rejection twice: for its tenant, and for those who see all tenants."""
    rows = rejections.select("id", "reason", "tenant_id", "source_id", F.col("created_at").alias("at"), F.lit("rejection").alias("kind"))
    return _shaped(rows.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))))


def state_rows(states: DataFrame) -> DataFrame:
    """Typed payloads; a partition that an instance lists twice keeps its last entry."""
    typed = states.where(F.col("service_name").isin(INGEST, PROCESSOR)).select(
        F.lit("state").alias("kind"), "service_name", F.col("instance_id").alias("id"), F.col("updated_at").alias("at"),
        F.when(F.col("service_name") == INGEST, F.from_json("payload", INGEST_STATE)).alias("ingest"),
        F.when(F.col("service_name") == PROCESSOR, F.from_json("payload", PROCESSOR_STATE)).alias("processor"))
    listed = F.col("processor.partitions")
    last = F.filter(listed, lambda p, at: ~F.exists(
        F.slice(listed, at + 2, F.greatest(F.size(listed) - at - 1, F.lit(0))), lambda later: later["partition"] == p["partition"]))
    return _shaped(typed.withColumn("processor", F.when(
        F.col("processor").isNotNull(), F.col("processor").withField("partitions", last))))


def folded(rows: DataFrame) -> DataFrame:
    """The current table: totals added up, the newest rejections, the newest state of each instance."""
    totals = _shaped(rows.where("kind = 'total'").groupBy("kind", "tenant_id").agg(F.sum("events_count").alias("events_count")))
    newest = Window.partitionBy("whole", F.when(~F.col("whole"), F.col("tenant_id"))).orderBy(F.desc("at"), F.desc("id"))
    rejections = rows.where("kind = 'rejection'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= NEWEST)
    latest = Window.partitionBy("service_name", "id").orderBy(F.desc("at"))
    states = rows.where("kind = 'state'").withColumn("n", F.row_number().over(latest)).where("n = 1")
    return totals.unionByName(_shaped(rejections)).unionByName(_shaped(states))


def answer(rows: DataFrame, principal: Principal, now_us: int) -> DataFrame:
    """The dashboard's one row from roll-up rows; the same columns and values as ``queries.overview``.

    One aggregate over one small partition, written as SQL text: nothing is shuffled.
    """
    now, all_tenants = f"timestamp_micros({now_us}L)", principal.role in (ADMIN, SERVICE, "")
    recent = f"kind = 'bucket' AND at >= timestamp_micros({now_us - MINUTE_US}L)"
    fresh = f"at >= timestamp_micros({now_us - STALE_AFTER_SECONDS * 1_000_000}L)"
    ingest, processor = f"service_name = '{INGEST}' AND {fresh}", f"service_name = '{PROCESSOR}' AND {fresh}"

    def total(field: str, where: str, name: str = "") -> str:
        return f"coalesce(sum({field}) FILTER (WHERE {where}), 0L) AS {name or field.split('.')[-1]}"

    def peak(field: str) -> str:
        return f"coalesce(max(processor.{field}) FILTER (WHERE {processor}), 0D) AS {field}"

    fields = ("lag", "processed_total", "duplicate_total", "late_event_total", "inflight_messages", "last_offset", "last_seen_at")
    health = "named_struct('partition', p.partition, 'owner_instance_id', id, " + ", ".join(f"'{f}', p.{f}" for f in fields) + ")"
    rejection = "named_struct('created_at', at, 'id', id, 'reason', reason, 'tenant_id', coalesce(tenant_id, ''), 'source_id', coalesce(source_id, ''))"
    shown = "named_struct('id', r.id, 'reason', r.reason, 'tenant_id', r.tenant_id, 'source_id', r.source_id, 'created_at', r.created_at)"
    seen = rows.where("whole OR kind <> 'rejection'") if all_tenants else rows.where(
        (F.col("tenant_id") == F.lit(principal.tenant_id)) & F.expr("NOT coalesce(whole, false) AND kind <> 'state'"))
    return seen.coalesce(1).selectExpr(
        total("events_count", recent, "events"), total("error_count", recent, "errors"), total("events_count", "kind = 'total'", "stored"),
        total("ingest.accepted_total", ingest), total("ingest.rejected_total", ingest), f"max(at) FILTER (WHERE {ingest}) AS ingest_last_seen_at",
        total("processor.processed_total", processor, "processor_processed_total"),
        *(total(f"processor.{f}", processor) for f in ("duplicate_total", "late_event_total", "dead_letter_total", "consumer_lag")),
        f"count(*) FILTER (WHERE {processor}) AS processor_instances",
        total("processor.active_partitions", processor, "processor_active_partitions"),
        total("processor.inflight_messages", processor, "processor_inflight_messages"),
        *(peak(f) for f in ("processing_p50_ms", "processing_p95_ms", "processing_p99_ms", "batch_size_p95", "batch_flush_p95_ms")),
        f"max(at) FILTER (WHERE {processor}) AS processor_last_seen_at",
        f"sort_array(flatten(collect_list(transform(processor.partitions, p -> {health})) FILTER (WHERE {processor}))) AS partition_health",
        f"transform(slice(sort_array(collect_list({rejection}) FILTER (WHERE kind = 'rejection'), false), 1, {NEWEST}), r -> {shown}) AS recent_rejections",
    ).selectExpr(
        f"{now} AS generated_at", "events / 60.0D AS events_per_second_last_minute",
        "coalesce(try_divide(cast(errors AS DOUBLE), cast(events AS DOUBLE)), 0D) AS error_rate_last_minute", "stored AS stored_processed_total",
        "* EXCEPT (events, errors, stored)", "stored AS processed_total",
        f"array({', '.join(repr(duration_label(s)) for s in WINDOW_SECONDS)}) AS window_sizes",
        f"'{duration_label(ALLOWED_LATENESS_SECONDS)}' AS allowed_lateness")
