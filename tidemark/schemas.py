"""Explicit schemas of every record the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, TIME, BINARY = T.DoubleType(), T.TimestampType(), T.BinaryType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENT = _struct(
    schema_version=LONG, event_id=STRING, tenant_id=STRING, source_id=STRING,
    event_type=STRING, timestamp=TIME, value=DOUBLE, status=STRING, region=STRING,
    sequence=LONG,
)
EVENT_FIELDS = EVENT.fieldNames()

LOG_HEADER = _struct(key=STRING, value=BINARY)
# Same shape as Spark's Kafka source with includeHeaders.
LOG_MESSAGE = _struct(
    key=BINARY, value=BINARY, topic=STRING, partition=INT, offset=LONG, timestamp=TIME,
    headers=T.ArrayType(LOG_HEADER),
)

# Where an archived event stood: in the log, or, if archived before it got there, in its request
POSITION = _struct(topic=STRING, partition=INT, offset=LONG, log_time=TIME, request=STRING, pos=INT)
ARCHIVE_LINE = _struct(archived_at=TIME, event=EVENT, raw_payload=STRING, position=POSITION)

DEAD_LETTER = _struct(
    failed_at=TIME, reason=STRING, error=STRING, source_topic=STRING,
    source_partition=INT, source_offset=LONG, source_key=STRING, consumer_group=STRING,
    event_id=STRING, tenant_id=STRING, source_id=STRING, payload_base64=STRING,
    headers=T.ArrayType(_struct(key=STRING, value_base64=STRING)),
)

PARTITION_STATE = _struct(
    partition=INT, owner_instance_id=STRING, lag=LONG, processed_total=LONG,
    duplicate_total=LONG, late_event_total=LONG, inflight_messages=LONG,
    last_offset=LONG, last_seen_at=TIME,
)
INGEST_STATE = _struct(
    accepted_total=LONG, rejected_total=LONG, last_seen_at=TIME, uptime_seconds=LONG,
)
PROCESSOR_STATE = T.StructType([
    *[T.StructField(n, LONG) for n in (
        "processed_total", "duplicate_total", "late_event_total", "dead_letter_total",
        "consumer_lag", "active_partitions", "inflight_messages")],
    T.StructField("last_seen_at", TIME),
    T.StructField("uptime_seconds", LONG),
    *[T.StructField(n, DOUBLE) for n in (
        "processing_p50_ms", "processing_p95_ms", "processing_p99_ms",
        "batch_size_p50", "batch_size_p95", "batch_size_p99",
        "batch_flush_p50_ms", "batch_flush_p95_ms", "batch_flush_p99_ms")],
    T.StructField("partitions", T.ArrayType(PARTITION_STATE)),
])
QUERY_STATE = _struct(request_count=LONG, last_seen_at=TIME, uptime_seconds=LONG)

# Long table of metric samples.
SAMPLE = T.StructType([
    T.StructField("run_id", STRING), T.StructField("sample_ts", TIME),
    T.StructField("metric", STRING),
    T.StructField("labels", T.MapType(STRING, STRING)), T.StructField("value", DOUBLE),
])

GATE = _struct(name=STRING, status=STRING, target=DOUBLE, observed=DOUBLE, unit=STRING)
METRIC = _struct(label=STRING, value=STRING, unit=STRING, tone=STRING)
BENCHMARK = _struct(
    artifact=STRING, started_at_utc=STRING, completed_at_utc=STRING, target_eps=DOUBLE,
    accepted_eps=DOUBLE, processed_eps=DOUBLE, query_p95_ms=DOUBLE, peak_lag=LONG,
    post_load_drain_seconds=DOUBLE, producer_count=LONG, processor_replicas=LONG,
    batch_size=LONG, summary=STRING, gaps=T.ArrayType(STRING), gates=T.ArrayType(GATE),
)
DRILL = _struct(
    scenario_id=STRING, title=STRING, status=STRING, artifact=STRING,
    started_at_utc=STRING, completed_at_utc=STRING, result=STRING, operator_note=STRING,
    remaining_gap=STRING, metrics=T.ArrayType(METRIC),
)
EVIDENCE = _struct(
    schema_version=LONG, generated_at=TIME, status=STRING, artifact_root=STRING,
    benchmark=BENCHMARK, failure_drills=T.ArrayType(DRILL),
)

# Hot views. Keys first, then the additive and max columns.
_MEASURES = dict(events_count=LONG, ok_count=LONG, warn_count=LONG, error_count=LONG, value_sum=DOUBLE)
VIEWS: dict[str, T.StructType] = {
    "processed_events": _struct(event_id=STRING, tenant_id=STRING, processed_at=TIME, bucket=INT),
    "tenant_metrics": _struct(bucket_start=TIME, tenant_id=STRING, **_MEASURES, last_event_at=TIME),
    "tenant_metric_shards": _struct(
        bucket_start=TIME, tenant_id=STRING, shard_id=INT, **_MEASURES, last_event_at=TIME),
    "source_metrics": _struct(tenant_id=STRING, source_id=STRING, events_count=LONG, last_event_at=TIME),
    "event_windows": _struct(
        window_size_seconds=INT, window_start=TIME, tenant_id=STRING, source_id=STRING,
        **_MEASURES, max_event_at=TIME),
    "rejection_events": _struct(
        id=STRING, reason=STRING, tenant_id=STRING, source_id=STRING, payload=STRING, created_at=TIME),
    "service_state": _struct(service_name=STRING, instance_id=STRING, payload=STRING, updated_at=TIME),
    "partition_marks": _struct(topic=STRING, partition=INT, max_event_time=TIME),
    "dead_letters": DEAD_LETTER,
    "batch_stats": _struct(
        instance_id=STRING, flushed_at=TIME, batch_size=LONG, recorded_count=LONG, duplicate_count=LONG,
        late_count=LONG, dead_letter_count=LONG, flush_ms=DOUBLE, per_recorded_ms=DOUBLE,
        dedup_claim_ms=DOUBLE, tenant_aggregate_ms=DOUBLE, source_aggregate_ms=DOUBLE,
        window_aggregate_ms=DOUBLE, commit_ms=DOUBLE,
        claim_rows=LONG, tenant_rows=LONG, source_rows=LONG, window_rows=LONG),
    "partition_progress": _struct(
        topic=STRING, partition=INT, processed_total=LONG, duplicate_total=LONG,
        late_event_total=LONG, last_offset=LONG, last_seen_at=TIME),
}
