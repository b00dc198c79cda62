"""The registered queries: every operator, run over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions.measures import displayed, log_partition, per_second, shard_id
from tidemark.functions.text import display_number, display_percent, encode_event, event_struct, partition_key, path_segment
from tidemark.functions.timeparts import bucket_start, seconds_between
from tidemark.operators import aggregates as agg
from tidemark.operators import alerts, counters, evidence, quantiles, runs, state
from tidemark.operators.admission import (
    ADMIN, BATCH_BODY_BYTES, TENANT_USER, Principal, admit_batches, admit_single, admitted_events, authorize_ingest,
)
from tidemark.operators.contracts import BENCHMARK_NUMBERS, BENCHMARK_TEXT, REPORT_TEXT, contract_violations, dead_letter_violations
from tidemark.operators.contracts import report_violations as report_contract
from tidemark.operators.deadletters import dead_letter_log, to_dead_letters
from tidemark.operators.decode import accepted, classify
from tidemark.operators.dedup import dedup_within, duplicates, first_arrivals
from tidemark.operators.dispositions import disposition_counts, with_lag
from tidemark.operators.lateness import mark_late, partition_marks
from tidemark.operators.rejections import rejection_counts, to_rejections
from tidemark.plans import queries as q
from tidemark.plans.apply import LOG_COLUMNS, WRITTEN, BatchOptions, apply_batch
from tidemark.plans.process import process_batch
from tidemark.plans.reader import Reader
from tidemark.plans.replay import (
    REPLAY_TIES, as_log, hot_totals, rebuild, rebuild_verdict, replay, replay_filter, replay_summary, replay_verdict,
)
from tidemark.plans.scope import scoped
from tidemark.session import shared_dir
from tidemark.sources.archive import archive_rows, log_position, read_archive, write_archive
from tidemark.sources.events import read_events_batch, read_events_stream, to_log_rows, write_log
from tidemark.sources.evidence import read_evidence, read_samples, write_report
from tidemark.sources.log import EVENT_LOG
from tidemark.sources.log import append as append_segments
from tidemark.sources.views import HotViews
from tidemark.streaming.job import ingest_requests, start_processor
from tidemark.streaming.native import native_windows, stateful_lateness

TENANT, SOURCE = "tenant_03", "sensor_000013"
ADMINISTRATOR, TENANT_PRINCIPAL = Principal(ADMIN), Principal(TENANT_USER, TENANT)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register; times leave the engine as zone-less UTC."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
            for f in df.schema.fields
        ])
    QUERIES[fn.__name__] = run
    return fn


def _now(spark: SparkSession, d: str) -> Column:
    return fx.as_of(spark, d).scalar()


def _legacy_and_shards(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutover sit in the unsharded table, later ones in shards."""
    recorded = fx.processed(spark, d).recorded
    legacy = agg.tenant_rollup(agg.base_grain(recorded.where(fx.before_cutover())))
    return legacy, agg.tenant_shards(agg.base_grain(recorded.where(~fx.before_cutover())))


# -- dedup, lateness, progress ---------------------------------------------------------


@query
def dedup_claims(spark, d):
    return fx.processed(spark, d).winners.select(
        "event_id", "tenant_id", "partition", "offset", F.col("log_time").alias("claimed_at"))


@query
def duplicate_rows(spark, d):
    p = fx.processed(spark, d)
    return duplicates(p.marked, p.winners).select("event_id", "partition", "offset")


@query
def late_events(spark, d):
    return fx.processed(spark, d).late.select("event_id", "tenant_id", "source_id", "timestamp", "max_event_time")


@query
def disposition_totals(spark, d):
    return disposition_counts(fx.processed(spark, d).progress)


@query
def partition_progress(spark, d):
    return fx.processed(spark, d).progress.drop("topic")


# -- aggregates --------------------------------------------------------------------------


def _shown(df):
    """Sums and averages to nine digits, as the order of addition decides on the last ones."""
    return df.withColumns({c: displayed(c) for c in ("value_sum", "average_value") if c in df.columns})


@query
def tenant_shards(spark, d):
    return _shown(agg.tenant_shards(fx.processed(spark, d).grain))


@query
def tenant_rollup(spark, d):
    legacy, shards = _legacy_and_shards(spark, d)
    return _shown(agg.tenant_rollup(shards, legacy))


@query
def source_metrics(spark, d):
    return agg.source_metrics(fx.processed(spark, d).grain)


@query
def event_windows(spark, d):
    return _shown(agg.event_windows(fx.processed(spark, d).grain))


@query
def extreme_windows(spark, d):
    """Windows of sources that measure in very small, usual and very large units."""
    unit = F.element_at(F.array(F.lit(1e-9), F.lit(1.0), F.lit(1e10)), F.substring("source_id", 8, 6).cast("int") % 3 + 1)
    recorded = fx.processed(spark, d).recorded.withColumn("value", F.col("value") * unit)
    return _shown(agg.event_windows(agg.base_grain(recorded)).select(
        "window_size_seconds", "window_start", "tenant_id", "source_id", "value_sum"))


@query
def event_windows_all_tenants(spark, d):
    """Flagship: 5-minute tenant windows over all sources."""
    windows = agg.event_windows(fx.processed(spark, d).grain, [300])
    return _shown(q.all_sources(windows).select(*[c for c in q.window_columns(_now(spark, d))]))


@query
def shard_ids(spark, d):
    sources = fx.telemetry(spark, d).select("tenant_id", "source_id").distinct()
    return sources.withColumn("shard_id", shard_id())


@query
def size_histogram(spark, d):
    """Sizes of per-minute batches of each log partition."""
    batches = fx.telemetry(spark, d).groupBy("partition", bucket_start("log_time", 60)).agg(F.count(F.lit(1)).alias("size"))
    return agg.histogram(batches, "size")


# -- read queries ------------------------------------------------------------------------


@query
def overview_rates(spark, d):
    legacy, shards = _legacy_and_shards(spark, d)
    return q.overview_rates(shards, legacy, _now(spark, d))


@query
def processed_total(spark, d):
    return q.processed_total(agg.source_metrics(fx.processed(spark, d).grain))


@query
def tenant_series(spark, d):
    legacy, shards = _legacy_and_shards(spark, d)
    return _shown(q.tenant_series(shards, legacy, TENANT, _now(spark, d), "12h"))


@query
def event_windows_tenant(spark, d):
    windows = agg.event_windows(fx.processed(spark, d).grain)
    return _shown(q.event_windows(windows, TENANT, _now(spark, d), window_size="5m", lookback="12h"))


@query
def event_windows_source(spark, d):
    windows = agg.event_windows(fx.processed(spark, d).grain)
    return _shown(q.event_windows(windows, TENANT, _now(spark, d), SOURCE, window_size="1m", lookback="12h"))


@query
def top_sources(spark, d):
    return q.top_sources(agg.source_metrics(fx.processed(spark, d).grain))


@query
def top_sources_tenant(spark, d):
    return q.top_sources(agg.source_metrics(fx.processed(spark, d).grain), limit=5, principal=TENANT_PRINCIPAL)


@query
def tenant_scope_view(spark, d):
    return scoped(agg.source_metrics(fx.processed(spark, d).grain), TENANT_PRINCIPAL)


@query
def overview(spark, d):
    legacy, shards = _legacy_and_shards(spark, d)
    sources = agg.source_metrics(fx.processed(spark, d).grain)
    states = fx.processor_rows(spark, d).unionByName(fx.ingest_rows(spark, d))
    return _dashboard(q.overview(shards, legacy, sources, _rejections(spark, d), states, _last_update(states)))


@query
def stored_overview(spark, d):
    """The dashboard's row read from the roll-up that two batches and an ingest run left."""
    views, _ = _stored(spark)
    log, states = fx.telemetry(spark, d), fx.processor_rows(spark, d).unionByName(fx.ingest_rows(spark, d))
    apply_batch(views, log.where(fx.before_cutover()), "run", 0, _OPTIONS)
    views.write("rejection_events", _rejections(spark, d), "ingest", 0)
    views.write("service_state", states, "ingest", 0)
    views.commit("ingest", 0)
    views.advance_overview("ingest", 0)
    apply_batch(views, log.where(~fx.before_cutover()), "run", 1, _OPTIONS)
    return _dashboard(Reader(views).overview(ADMINISTRATOR, _last_update(states)))


def _dashboard(row: DataFrame) -> DataFrame:
    return row.select(
        "generated_at", "events_per_second_last_minute", "error_rate_last_minute", "processed_total",
        "stored_processed_total", "accepted_total", "rejected_total", "processor_processed_total", "duplicate_total",
        "late_event_total", "consumer_lag", "processor_instances", "processor_active_partitions", "processing_p95_ms",
        "allowed_lateness", F.array_join("window_sizes", ",").alias("window_sizes"),
        F.size("partition_health").alias("partition_count"),
        F.array_join(F.transform("recent_rejections", lambda r: r["id"]), ",").alias("rejection_ids"),
    )


# -- decode, validate, admit ------------------------------------------------------------


@query
def validate_reasons(spark, d):
    return classify(fx.raw_messages(spark, d)).select("n", "reason", "error", "event.event_id", "event.tenant_id")


@query
def contract_violation_counts(spark, d):
    found = contract_violations(fx.raw_messages(spark, d)).select(F.explode("violations").alias("violation"))
    return found.groupBy("violation").agg(F.count(F.lit(1)).alias("total"))


def _letters(spark, d) -> DataFrame:
    failed = classify(fx.raw_messages(spark, d)).where("reason IS NOT NULL")
    return to_dead_letters(failed, "telemetry-processor", F.col("log_time"))


@query
def dead_letters(spark, d):
    return _letters(spark, d).withColumn(
        "headers", F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value_base64"])), ","))


@query
def dead_letters_by_reason(spark, d):
    return agg.count_by(_letters(spark, d))


@query
def dead_letter_contract(spark, d):
    """Published dead letters keep their own contract: every record, no violation."""
    checked = dead_letter_violations(dead_letter_log(_letters(spark, d)))
    return checked.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("violations")).alias("violations"))


@query
def admitted_batches(spark, d):
    return admit_batches(fx.batch_requests(spark, d), ADMINISTRATOR).drop("payload")


@query
def admitted_rows(spark, d):
    return admitted_events(fx.batch_requests(spark, d), ADMINISTRATOR).select(
        "request_id", "pos", "event_id", "tenant_id", "timestamp", "value")


@query
def admitted_singles(spark, d):
    """One event per request, sent by a tenant user."""
    raw = fx.raw_messages(spark, d).withColumnRenamed("value", "body").select("n", "body")
    return admit_single(raw, TENANT_PRINCIPAL).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("total"))


@query
def authorized_events(spark, d):
    return authorize_ingest(fx.broken_events(spark, d), TENANT_PRINCIPAL).select("event_id", "tenant_id")


def _rejections(spark, d) -> DataFrame:
    requests = fx.batch_requests(spark, d)
    verdicts = admit_batches(requests, ADMINISTRATOR).join(requests.select("request_id", "received_at"), "request_id")
    return to_rejections(verdicts, F.col("payload"), F.col("received_at"), F.col("request_id"))


@query
def rejections(spark, d):
    return _rejections(spark, d).drop("payload")


@query
def rejections_recent(spark, d):
    return q.recent_rejections(_rejections(spark, d))


@query
def rejections_by_reason(spark, d):
    return rejection_counts(admit_batches(fx.batch_requests(spark, d), ADMINISTRATOR))


# -- publish, archive, replay ------------------------------------------------------------


@query
def published_log(spark, d):
    rows = to_log_rows(fx.telemetry(spark, d).where("copy_no = 0"))
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")


def _archive(spark, d) -> DataFrame:
    """Archive lines of every arrival, with the path they would be stored under."""
    t = fx.telemetry(spark, d)
    rows = archive_rows(t, F.lit("not json"), F.col("log_time"))
    return rows.withColumn("path", F.concat_ws("/", F.col("day").cast("string"), "tenant", "hour"))


@query
def archive_partitions(spark, d):
    return _archive(spark, d).groupBy("day", "tenant", "hour").agg(F.count(F.lit(1)).alias("line_count"))


@query
def zero_time_partitions(spark, d):
    """Events without a time are filed under their archive time: null and the first instant of year 1."""
    zero = F.when(F.col("n") % 2 == 0, F.lit("0001-01-01 00:00:00").cast("timestamp"))
    t = fx.telemetry(spark, d).withColumn("timestamp", F.when(F.col("n") % 5 == 0, zero).otherwise(F.col("timestamp")))
    return archive_rows(t, F.lit("not json"), F.col("log_time")).groupBy("day", "tenant", "hour").agg(
        F.count(F.lit(1)).alias("line_count"))


@query
def archive_paths(spark, d):
    """Path segments of spoiled tenant ids."""
    return fx.broken_events(spark, d).groupBy(path_segment(F.concat("tenant_id", F.lit("/"))).alias("segment")).agg(
        F.count(F.lit(1)).alias("total"))


@query
def replayed_events(spark, d):
    return replay_filter(_archive(spark, d), TENANT).select("archived_at", "event.event_id", "event.source_id", "event.value")


@query
def replayed_limit(spark, d):
    return replay_filter(_archive(spark, d), TENANT, 25).select("archived_at", "event.event_id")


@query
def replay_totals(spark, d):
    return replay_summary(_archive(spark, d), TENANT)


@query
def rebuilt_sources(spark, d):
    """Hot source counts rebuilt from the archive equal the live ones."""
    source = F.substring("event.source_id", 8, 6).cast("int")
    log = as_log(replay_filter(_archive(spark, d)), fx.LOG_PARTITIONS, source % fx.LOG_PARTITIONS)
    rebuilt = process_batch(log, block=600_000_000, ties=("event_id",))
    return agg.source_metrics(rebuilt.grain)


# -- stored views and a written archive --------------------------------------------------


def _stored(spark: SparkSession) -> tuple[HotViews, str]:
    """Empty views and an archive root of their own in the cluster's shared folder."""
    root = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    return HotViews(spark, f"{root}/views", claim_buckets=16), f"{root}/archive"


_OPTIONS = BatchOptions(block=fx.OFFSET_BLOCK, snapshot_seconds=None)


def _archived(spark: SparkSession, d: str, root: str, archived_at: Column | None = None) -> DataFrame:
    log = fx.telemetry(spark, d)
    stamp = F.col("log_time") if archived_at is None else archived_at
    write_archive(archive_rows(log, F.lit(None).cast("string"), stamp, log_position()), root)
    return log


def _rebuilt(spark: SparkSession, d: str) -> HotViews:
    """Views rebuilt from an archive whose lines are all stamped alike, as those of one ingested batch."""
    views, root = _stored(spark)
    apply_batch(views, _archived(spark, d, root, F.current_timestamp()), "stream", 0, _OPTIONS)
    tenants = [f"tenant_{i:02d}" for i in range(10)]
    rebuild(views, root, "2024-01-01", "2024-01-02", tenants, "rebuild", fx.LOG_PARTITIONS, block=fx.OFFSET_BLOCK)
    return views


@query
def restarted_views(spark, d):
    """A stream that starts over with a new checkpoint, and so with batch 0, loses nothing."""
    views, _ = _stored(spark)
    log = fx.telemetry(spark, d)
    apply_batch(views, log.where(fx.before_cutover()), "stream.first", 0, _OPTIONS)
    apply_batch(views, log.where(~fx.before_cutover()), "stream.second", 0, _OPTIONS)
    return views.read("source_metrics")


@query
def claims_across_batches(spark, d):
    """Progress of two batches: claims and marks of the first hold in the second."""
    views, _ = _stored(spark)
    log = fx.telemetry(spark, d)
    apply_batch(views, log.where(fx.before_cutover()), "run", 0, _OPTIONS)
    apply_batch(views, log.where(~fx.before_cutover()), "run", 1, _OPTIONS)
    return views.read("partition_progress").drop("topic")


@query
def batch_stats(spark, d):
    """Statistics of two batches, as observed on their writes; durations differ by run, so only that they were taken."""
    views, _ = _stored(spark)
    log = fx.telemetry(spark, d)
    for at, part in enumerate((log.where(fx.before_cutover()), log.where(~fx.before_cutover()))):
        apply_batch(views, part, "run", at, _OPTIONS)
    stages = ("flush_ms", "per_recorded_ms", "dedup_claim_ms", "tenant_aggregate_ms", "source_aggregate_ms", "window_aggregate_ms", "commit_ms")
    return views.deltas("batch_stats").select(
        "batch_id", "batch_size", "recorded_count", "duplicate_count", "late_count", "dead_letter_count", *WRITTEN.values(),
        F.size(F.filter(F.array(*stages), lambda ms: ms > 0)).alias("timed_stages"))


@query
def partition_lag(spark, d):
    """How far a processor that stopped at the cutover is behind the log."""
    log = fx.telemetry(spark, d)
    done = process_batch(log.where(fx.before_cutover()), block=fx.OFFSET_BLOCK)
    ends = log.groupBy("topic", "partition").agg(F.max("offset").alias("end_offset"))
    return with_lag(done.progress, ends).select("partition", "processed_total", "last_offset", "lag", "inflight_messages")


@query
def rebuilt_views(spark, d):
    """Stored views after all tenants are reset and rebuilt from the written archive."""
    return _rebuilt(spark, d).read("source_metrics")


@query
def rebuilt_windows(spark, d):
    """5-minute tenant windows rebuilt from the written archive equal the live ones."""
    windows = _rebuilt(spark, d).read("event_windows").where("window_size_seconds = 300")
    return _shown(q.all_sources(windows).select(*[c for c in q.window_columns(_now(spark, d))]))


@query
def reset_totals(spark, d):
    """Hot totals after one tenant is reset."""
    views, _ = _stored(spark)
    apply_batch(views, fx.telemetry(spark, d), "stream", 0, _OPTIONS)
    views.reset_tenants([TENANT])
    return hot_totals(views)


@query
def replay_outcome(spark, d):
    """Replaying one tenant's archive over stored views adds nothing."""
    views, root = _stored(spark)
    apply_batch(views, _archived(spark, d, root), "stream", 0, _OPTIONS)
    before = spark.createDataFrame(hot_totals(views, TENANT).collect(), "processed_events long, source_events long")
    again = replay(spark, root, "2024-01-01", "2024-01-02", TENANT)
    result = apply_batch(views, as_log(again, fx.LOG_PARTITIONS, run_id="again"), "again", 0, BatchOptions(
        block=fx.OFFSET_BLOCK, ties=REPLAY_TIES, snapshot_seconds=None))
    return replay_verdict(before, hot_totals(views, TENANT), again.count(), result.duplicate)


@query
def archive_scan(spark, d):
    """One tenant's lines of a written archive."""
    _, root = _stored(spark)
    _archived(spark, d, root)
    return read_archive(spark, root, "2024-01-01", "2024-01-02", TENANT).select(
        "event.event_id", "event.source_id", "event.timestamp", "archived_at")


# -- streams over stored segments ---------------------------------------------------------


def _segments(spark: SparkSession, d: str, log: DataFrame) -> tuple[DataFrame, str]:
    """The log stored as segments, and a stream that reads it from its start in three or more micro-batches."""
    root = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    append_segments(fx.log_messages(log), f"{root}/log")
    options = {"startingOffsets": "earliest", "maxRowsPerTrigger": str(log.count() // 3 + 1), "group": "query"}
    return read_events_stream(spark, EVENT_LOG, options, f"{root}/log"), root


def _drained(stream: DataFrame, root: str) -> DataFrame:
    """What an append stream wrote by the time that its source has nothing more."""
    running = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(
        processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query
def streamed_log(spark, d):
    """Rows and offsets of each log partition, read from segments by a stream with a row limit."""
    stream, root = _segments(spark, d, fx.telemetry(spark, d))
    read = _drained(stream.select("partition", "offset", "log_time"), root)
    return read.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.max("log_time").alias("last_seen_at"))


@query
def bounded_log(spark, d):
    """The same log in a batch read."""
    _, root = _segments(spark, d, fx.telemetry(spark, d))
    read = read_events_batch(spark, EVENT_LOG, path=f"{root}/log")
    return read.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.max("log_time").alias("last_seen_at"))


@query
def streamed_late_events(spark, d):
    """Lateness as keyed state of a stream that goes on from the marks of the hours before."""
    log = fx.telemetry(spark, d)
    done, rest = log.where(fx.before_cutover()), log.where(~fx.before_cutover())
    stream, root = _segments(spark, d, rest)
    judged = stateful_lateness(accepted(classify(stream), LOG_COLUMNS), marks=partition_marks(done), block=fx.OFFSET_BLOCK)
    before = mark_late(done, block=fx.OFFSET_BLOCK).select(*judged.columns)
    late = first_arrivals(before.unionByName(_drained(judged, root))).where("late")
    return late.select("event_id", "tenant_id", "source_id", "timestamp", "max_event_time")


@query
def keyed_partitions(spark, d):
    """The log partition of every key."""
    keys = fx.telemetry(spark, d).select(partition_key().alias("key")).distinct()
    return keys.select("key", log_partition("key", fx.LOG_PARTITIONS).alias("partition"))


@query
def published_partitions(spark, d):
    """Messages published as segments: each partition is one task, which numbers its rows."""
    root = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    write_log(to_log_rows(fx.telemetry(spark, d)), EVENT_LOG, {"partitions": str(fx.LOG_PARTITIONS)}, root)
    return read_events_batch(spark, EVENT_LOG, path=root).groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.count_distinct("key").alias("keys"))


@query
def keyed_late_events(spark, d):
    """Lateness of archived events that go to the partitions of their keys, as a rebuild without a partition column sends them."""
    log = as_log(replay_filter(_archive(spark, d)), fx.LOG_PARTITIONS)
    late = process_batch(log, block=600_000_000, ties=REPLAY_TIES).late
    return late.select("event_id", "partition", "timestamp", "max_event_time")


# -- service state -----------------------------------------------------------------------


def _last_update(states: DataFrame) -> Column:
    return states.agg(F.max("updated_at")).scalar()


@query
def processor_totals(spark, d):
    states = fx.processor_rows(spark, d)
    return state.processor_state(state.live_states(states, state.PROCESSOR, _last_update(states))).drop(
        "dead_letter_total", "inflight_messages", "batch_size_p95", "batch_flush_p95_ms")


@query
def ingest_totals(spark, d):
    states = fx.ingest_rows(spark, d)
    return state.ingest_state(state.live_states(states, state.INGEST, _last_update(states), 120))


@query
def partition_health(spark, d):
    states = fx.processor_rows(spark, d)
    return q.partitions(states, _last_update(states)).drop("last_seen_at")


@query
def hottest_partitions(spark, d):
    states = fx.processor_rows(spark, d)
    health = state.partition_health(state.live_states(states, state.PROCESSOR, _last_update(states)))
    return state.hottest_partitions(health).select("partition", "owner_instance_id", "lag")


@query
def latest_service_state(spark, d):
    """Every partition report is an upsert; the newest per instance stays."""
    p = fx.processed(spark, d).progress
    rows = p.select(F.lit(state.PROCESSOR).alias("service_name"), fx.instance_id().alias("instance_id"),
                    F.col("partition").cast("string").alias("payload"), F.col("last_seen_at").alias("updated_at"))
    return state.latest_state(rows)


@query
def heartbeat_class(spark, d):
    t = fx.telemetry(spark, d)
    seen = t.groupBy("source_id").agg(F.max("log_time").alias("last_seen_at"))
    return seen.select("source_id", state.freshness_class(F.col("last_seen_at"), t.agg(F.max("log_time")).scalar()).alias("freshness"))


@query
def system_status(spark, d):
    grain = fx.processed(spark, d).grain
    by_tenant = grain.groupBy("tenant_id").agg(F.sum("events_count").alias("n"), F.sum("error_count").alias("e"))
    rate = F.col("e") / F.col("n")
    return by_tenant.select("tenant_id", state.system_status(F.lit(0), rate, max_error_rate=0.2).alias("status"),
                            display_percent(F.round(rate, 6)).alias("error_rate"),
                            display_number("n").alias("events"),
                            F.round(state.processed_percent(F.col("n") - F.col("e"), F.col("n")), 6).alias("processed_percent"))


# -- metric samples ----------------------------------------------------------------------


@query
def counter_increase(spark, d):
    return counters.counter_increase(fx.counter_samples(spark, d), ["instance_id"], block=3_600_000_000)


@query
def run_rates(spark, d):
    return runs.run_rates(fx.run_samples(spark, d))


@query
def run_peaks(spark, d):
    return runs.run_peaks(fx.run_samples(spark, d), {"consumer_lag": "peak_consumer_lag", "processing_p95_ms": "peak_processing_p95_ms"})


def _metric(spark, d, name: str) -> DataFrame:
    return fx.run_samples(spark, d).where(F.col("metric") == name)


def _markers(spark, d) -> DataFrame:
    """Half an hour into each run."""
    starts = fx.run_samples(spark, d).groupBy("run_id").agg(F.min("sample_ts").alias("s"), F.min_by(
        F.when(F.col("metric") == "consumer_lag", F.col("value")),
        F.when(F.col("metric") == "consumer_lag", F.col("sample_ts"))).alias("target_lag"))
    return starts.select("run_id", (F.col("s") + F.expr("INTERVAL 30 MINUTES")).alias("marked_at"), "target_lag")


@query
def drain_seconds(spark, d):
    stops = _markers(spark, d).withColumnRenamed("marked_at", "stopped_at")
    return runs.drain_seconds(_metric(spark, d, "consumer_lag"), stops, 900)


@query
def recovery_by_lag(spark, d):
    return runs.recovery_by_lag(_metric(spark, d, "consumer_lag"), _markers(spark, d), 1)


@query
def recovery_by_counter(spark, d):
    return runs.recovery_by_counter(_metric(spark, d, "processed_total"), _markers(spark, d))


@query
def accounting_gap(spark, d):
    return counters.accounting_gap(counters.counter_increase(fx.run_samples(spark, d), ["run_id", "metric"]))


@query
def nearest_rank_percentiles(spark, d):
    return quantiles.nearest_rank(fx.telemetry(spark, d), ["tenant_id"], "value")


@query
def rolling_quantiles(spark, d):
    return quantiles.rolling_quantiles(fx.telemetry(spark, d), ["partition"], ["offset"], "value", 256)


@query
def histogram_quantile(spark, d):
    samples = fx.bucket_samples(spark, d)
    growth = counters.bucket_growth(samples, ["stage"], samples.agg(F.max("sample_ts")).scalar(), 7200, ["instance_id"])
    return counters.histogram_quantile(growth, ["stage"])


def _reports(spark, d) -> DataFrame:
    """One load report per run; rates are scaled so every band of the gates occurs."""
    s, hour = fx.run_samples(spark, d), F.substring("run_id", 5, 2).cast("int")
    rates = runs.run_rates(s).select("run_id", "accepted_total_delta", "processed_total_delta", "measured_duration_seconds")
    peaks = runs.run_peaks(s, {"consumer_lag": "lag", "processing_p95_ms": "query_p95_ms"})
    return rates.join(peaks, "run_id").select(
        "run_id", F.lit(5000.0).alias("target_eps"), (F.col("accepted_total_delta") * (hour + 1) * 1.0).alias("accepted_eps"),
        (F.col("processed_total_delta") * (hour + 1) * 1.0).alias("processed_eps"), "query_p95_ms",
        (F.col("lag") * (hour + 1) * 1000).cast("bigint").alias("peak_lag"), (hour * 5.0).alias("post_load_drain_seconds"),
    )


@query
def gates(spark, d):
    return evidence.evaluate_gates(_reports(spark, d))


@query
def gap_messages(spark, d):
    return _reports(spark, d).select("run_id", F.posexplode(evidence.gap_messages()).alias("pos", "message"))


@query
def throughput_by_tenant(spark, d):
    t = fx.processed(spark, d).recorded
    spans = t.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return spans.select("tenant_id", per_second("n", F.floor(seconds_between(F.col("b"), "a")).cast("double"), 4).alias("eps"))


@query
def lag_alerts(spark, d):
    lag = fx.minute_counts(spark, d).select("sample_ts", "instance_id", (F.col("late") + F.col("duplicate")).cast("double").alias("value"))
    return alerts.lag_alert(lag, 1, 120)


@query
def rate_alerts(spark, d):
    return alerts.rate_alert(fx.counter_samples(spark, d), ["instance_id"], 0.2, 300, 60)


@query
def trailing_rates(spark, d):
    return alerts.trailing_rate(fx.counter_samples(spark, d), ["instance_id"], 300)


@query
def liveness_alerts(spark, d):
    """An instance counts as down in a minute with fewer than three arrivals."""
    up = fx.minute_counts(spark, d).select("sample_ts", "instance_id", (F.col("arrived") >= 3).cast("double").alias("value"))
    return alerts.liveness_alerts(up, 60)


# Which runs played which drill
_DRILLS = {"restart-processor": (0, 1), "broker-outage": (2, 3), "pause-postgres": (4, 5), "replay-archive": (6, 7)}


def _drill_files(spark, d) -> DataFrame:
    """Report files derived from the runs; no run plays the poison drill."""
    hour = F.substring("run_id", 5, 2).cast("int")
    kind = F.lit("benchmark")
    for name, hours in _DRILLS.items():
        kind = F.when(hour.isin(*hours), name).otherwise(kind)
    s = fx.run_samples(spark, d)
    rates, gap = runs.run_rates(s), counters.accounting_gap(counters.counter_increase(s, ["run_id", "metric"]))
    peaks = runs.run_peaks(s, {"consumer_lag": "peak_consumer_lag"})
    ends = s.groupBy("run_id").agg(F.min("sample_ts").alias("a"), F.max("sample_ts").alias("b"))
    wide = rates.join(gap.select("run_id", "archive_accounting_gap", "publish_failed_total_delta"), "run_id").join(
        peaks, "run_id").join(ends, "run_id")
    even = F.col("processed_total_delta") % 2 == 0
    payload = F.to_json(F.struct(
        F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at_utc"),
        F.date_format("b", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finished_at"),
        even.alias("lag_recovered_within_window"), F.lit(True).alias("accepted_recovered_within_window"),
        even.alias("processed_recovered_within_window"), F.lit(True).alias("duplicate_safe"), even.alias("rebuild_restored"),
        hour.cast("double").alias("recovery_seconds"), (hour + 0.25).alias("processed_recovery_seconds"),
        "peak_consumer_lag", "accepted_total_delta", "processed_total_delta", "archive_accounting_gap",
        "publish_failed_total_delta", F.lit(5000).alias("rate_target_eps"),
        (F.col("accepted_total_delta") * 1.0).alias("accepted_eps"), (F.col("processed_total_delta") * 1.0).alias("processed_eps"),
    ))
    return wide.select(kind.alias("kind"), F.concat(F.col("run_id"), F.lit(".json")).alias("artifact"),
                       F.col("b").alias("modified_at"), payload.alias("payload"))


@query
def drill_summary(spark, d):
    shown = F.array_join(F.transform("metrics", lambda m: F.concat(m["label"], F.lit("="), m["value"])), ";")
    return evidence.drill_summary(_drill_files(spark, d)).withColumn("metrics", shown)


@query
def evidence_summary(spark, d):
    files = _drill_files(spark, d)
    row = evidence.evidence_summary(files, "artifacts", files.agg(F.max("modified_at")).scalar())
    return row.select(
        "schema_version", "generated_at", "status", "artifact_root", "benchmark.artifact", "benchmark.summary",
        F.size("benchmark.gaps").alias("gap_count"),
        F.size(F.filter("benchmark.gates", lambda g: g["status"] == "pass")).alias("gates_passed"),
        F.array_join(F.transform("failure_drills", lambda x: x["status"]), ",").alias("drill_states"),
    )


# -- jobs whose rows come from running them -------------------------------------------------


def _dead_letter_totals(spark, d, keys: tuple[str, ...] = ()) -> DataFrame:
    """Snapshots of the dead-letter log, or of what each instance sent there: a running total per minute."""
    failed = classify(fx.raw_messages(spark, d)).where("reason IS NOT NULL").withColumn("instance_id", fx.instance_id())
    per_minute = failed.groupBy(*keys, bucket_start("log_time", 60).alias("sample_ts")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("sample_ts")
    return per_minute.select(*keys, "sample_ts", F.sum("n").over(order).alias("value"))


def _hours(spark, d) -> DataFrame:
    """Each run with the hour that it takes."""
    runs_ = fx.run_samples(spark, d).groupBy("run_id").agg(F.min(bucket_start("sample_ts", 3600)).alias("started_at"))
    return runs_.withColumn("finished_at", F.col("started_at") + F.expr("INTERVAL 1 HOUR"))


@query
def dead_letter_deltas(spark, d):
    """Dead letters of each instance between the start and the end of each run, from snapshots."""
    instances = fx.telemetry(spark, d).select(fx.instance_id().alias("instance_id")).distinct()
    each = _hours(spark, d).withColumn("instance_id", F.explode(instances.agg(F.sort_array(F.collect_list("instance_id"))).scalar()))
    return evidence.dead_letter_delta(each, _dead_letter_totals(spark, d, ("instance_id",)), ["instance_id"]).select("run_id", "instance_id", "dead_letter_delta")


@query
def poison_drill(spark, d):
    """The poison drill's verdict on the first run."""
    found = evidence.dead_letter_delta(_hours(spark, d), _dead_letter_totals(spark, d))
    report = found.orderBy("finished_at").limit(1).select(
        F.lit("inject-poison-message").alias("kind"), F.concat("run_id", F.lit(".json")).alias("artifact"), F.col("finished_at").alias("modified_at"),
        F.to_json(F.struct(F.col("dead_letter_delta").cast("double").alias("dead_letter_delta"))).alias("payload"))
    return evidence.drill_summary(report).where("scenario_id = 'poison-message'").select("scenario_id", "status", "artifact", "result")


def _in_steps(spark: SparkSession, steps: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an append stream over stored segments writes when each step arrives after the one before is done."""
    root = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    append_segments(fx.log_messages(steps[0]), f"{root}/log")
    messages = read_events_stream(spark, EVENT_LOG, {"startingOffsets": "earliest"}, f"{root}/log")
    out = build(accepted(classify(messages), LOG_COLUMNS))
    running = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(
        processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
        for step in steps[1:]:
            append_segments(fx.log_messages(step), f"{root}/log")
            running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _again(rows: DataFrame, minutes: int) -> DataFrame:
    """Copies whose offsets follow all others, with event times so many minutes later."""
    return rows.where("copy_no = 0").withColumns({
        "offset": F.col("offset") + F.lit(6 << 59), "timestamp": F.col("timestamp") + F.make_dt_interval(mins=F.lit(minutes))})


def _event_hours(first: int, last: int) -> Column:
    at = F.unix_micros("timestamp") - fx.EPOCH_US
    return (at >= first * 3_600_000_000) & (at < last * 3_600_000_000)


@query
def deduped_within(spark, d):
    """Ids remembered for an hour: copies of the last hour go, copies of hours before come through again."""
    log = fx.telemetry(spark, d)
    inside, outside = log.where(_event_hours(11, 13)), log.where(_event_hours(0, 2))
    late = _again(inside, 0).unionByName(_again(outside, 690))
    kept = _in_steps(spark, [log.where(fx.before_cutover()), log.where(~fx.before_cutover()), late],
                     lambda events: dedup_within(events, "1 hour").select("event_id"))
    return kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("passed"))


@query
def closed_windows(spark, d):
    """Windows that one watermark has closed: what comes for them afterwards is dropped."""
    log = fx.telemetry(spark, d)
    steps = [log.where(fx.before_cutover()), log.where(~fx.before_cutover()), _again(log.where(_event_hours(1, 2)), 0)]
    return _shown(_in_steps(spark, steps, lambda events: native_windows(events, 300)))


@query
def processor_stream(spark, d):
    """The processor over segments with poison messages, stopped by a failure in its second batch and started again."""
    log = fx.telemetry(spark, d)
    poison = fx.log_messages(log.where("n % 100 = 0 and n % 13 != 0")).withColumns(
        {"offset": F.col("offset") + 1, "value": F.lit('{"schema_version":1').cast("binary")})
    messages, views = fx.log_messages(log).unionByName(poison), _stored(spark)[0]
    append_segments(messages, f"{views.root}-log")
    options = {"startingOffsets": "earliest", "maxRowsPerTrigger": str(messages.count() // 3 + 1), "group": "processor"}
    commits = []

    def fault(stage: str) -> None:
        if stage == "commit":
            commits.append(stage)
            if len(commits) == 2:
                raise RuntimeError("stopped before the second commit")

    stream = read_events_stream(spark, EVENT_LOG, options, f"{views.root}-log")
    for _ in range(2):
        running = start_processor(stream, views, f"{views.root}-checkpoint", options=_OPTIONS, interval="0 seconds", fault=fault)
        try:
            running.processAllAvailable()
        except StreamingQueryException:
            pass  # the failure above; the next start repeats the batch
        finally:
            running.stop()
    views.refresh()
    sources = views.read("source_metrics").select("tenant_id", "source_id", "events_count")
    letters = views.read("dead_letters").groupBy(F.lit("dead letters").alias("tenant_id"), F.col("reason").alias("source_id")).agg(
        F.count(F.lit(1)).alias("events_count"))
    return sources.unionByName(letters)


@query
def ingested_totals(spark, d):
    """Accepted events and rejected requests as an ingest job counts them over two batches, the second after a restart."""
    views, root = _stored(spark)
    requests = fx.batch_requests(spark, d)
    for at, part in enumerate((requests.where("request_id % 2 = 0"), requests.where("request_id % 2 = 1"))):
        ingest_requests(part, ADMINISTRATOR, HotViews(spark, views.root), root, "parquet", {}, f"{root}-log", "ingest", at)
    states = views.read("service_state")
    return state.ingest_state(state.live_states(states, state.INGEST, _last_update(states))).drop("last_seen_at")


@query
def rebuild_outcome(spark, d):
    """Nothing is left after the reset, everything is there after the rebuild."""
    views, root = _stored(spark)
    apply_batch(views, _archived(spark, d, root), "stream", 0, _OPTIONS)
    tenants = [f"tenant_{i:02d}" for i in range(10)]
    before = hot_totals(views).first()["source_events"]
    views.reset_tenants(tenants)
    after_reset = spark.createDataFrame(hot_totals(views).collect(), "processed_events long, source_events long")
    rebuild(views, root, "2024-01-01", "2024-01-02", tenants, "rebuild", fx.LOG_PARTITIONS, block=fx.OFFSET_BLOCK)
    again = hot_totals(views).select(F.col("source_events").alias("processed_events"), "source_events")
    return rebuild_verdict(after_reset, again, before)


# -- stored reports and samples ------------------------------------------------------------


def _report(spark, d) -> DataFrame:
    files = _drill_files(spark, d)
    return evidence.evidence_summary(files, "artifacts", files.agg(F.max("modified_at")).scalar())


def _report_row(row: DataFrame) -> DataFrame:
    return row.select(
        "schema_version", "status", "artifact_root", "benchmark.artifact", F.size("benchmark.gaps").alias("gap_count"),
        F.size("failure_drills").alias("drill_count"), F.array_join(F.transform("failure_drills", lambda x: x["status"]), ",").alias("drill_states"))


@query
def stored_report(spark, d):
    """A written report read back, and what a report that is not there reads as: lists are empty, never null."""
    root = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    write_report(_report(spark, d), f"{root}/summary")
    return _report_row(read_evidence(spark, f"{root}/summary")).unionByName(
        _report_row(read_evidence(spark, f"{root}/none")).withColumns({
            "artifact_root": F.lit(""), "gap_count": F.coalesce("gap_count", F.lit(0))}))


@query
def stored_samples(spark, d):
    """Run rates from a stored sample table."""
    path = shared_dir(spark, "tidemark-queries", uuid.uuid4().hex)
    fx.run_samples(spark, d).withColumn("labels", F.create_map(F.lit("run"), F.col("run_id"))).write.parquet(path)
    return runs.run_rates(read_samples(spark, path).select("run_id", "sample_ts", "metric", "value"))


# How a report is spoiled: pattern, replacement, the violations that must be found
_TOP = r'^(\{"schema_version":1.*?)'
REPORT_SPOILS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("$^", "", ()),
    ('"schema_version":1', '"schema_version":2', ("schema_version: const",)),
    *((f'{_TOP}"{n}":"[^"]*"', f'$1"{n}":7', (f"{n}: string",)) for n in REPORT_TEXT),
    (r'"benchmark":\{.*\},"failure_drills"', '"benchmark":[],"failure_drills"', (
        "benchmark: object", *(f"benchmark.{n}: string" for n in BENCHMARK_TEXT), *(f"benchmark.{n}: number" for n in BENCHMARK_NUMBERS),
        "benchmark.gaps: array", "benchmark.gates: array")),
    (r'"gaps":\[', '"gaps":[5,', ("benchmark.gaps: items",)),
    (r'"gates":\[\{"name":"[^"]*"', '"gates":[{"name":1', ("benchmark.gates: items",)),
    (r'"failure_drills":\[.*\]\}$', '"failure_drills":{}}', ("failure_drills: array",)),
    ('"scenario_id":"restart-processor"', '"scenario_id":1', ("failure_drills: items",)),
    (r"^.*$", "[1]", ("type: object",)),
)


@query
def report_violations(spark, d):
    """Every rule of the report contract, broken at least once."""
    text = _report(spark, d).select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("text"))
    spoils = F.array(*(F.struct(F.lit(i).alias("spoil"), F.lit(a).alias("pattern"), F.lit(b).alias("by")) for i, (a, b, _) in enumerate(REPORT_SPOILS)))
    every = text.select("text", F.explode(spoils).alias("s")).select("s.spoil", F.regexp_replace("text", F.col("s.pattern"), F.col("s.by")).alias("value"))
    return report_contract(every).select("spoil", F.explode_outer("violations").alias("violation"))


@query
def body_limits(spark, d):
    """Requests of up to 500 events, of 501, of none, and bodies of the largest size and one byte more."""
    rows = fx.telemetry(spark, d).where("copy_no = 0").select(
        F.floor(F.col("n") / 1002).alias("g"), (F.col("n") % 1002).alias("at"), "n", encode_event(event_struct()).alias("text"))
    kind = F.when(F.col("at") < 500, "full").when(F.col("at") < 1001, "over").otherwise("sized")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"])
    grouped = rows.groupBy("g", kind.alias("kind")).agg(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("body"))
    size = F.lit(BATCH_BODY_BYTES) + F.col("g") % 2
    padded = F.when(F.col("kind") == "sized", F.concat(F.repeat(F.lit(" "), (size - F.octet_length("body")).cast("int")), "body")).otherwise(F.col("body"))
    requests = grouped.select(F.concat_ws("-", "kind", "g").alias("request_id"), padded.alias("body")).unionByName(
        rows.select(F.concat(F.lit("none-"), F.col("g")).alias("request_id"), F.lit("[]").alias("body")).distinct())
    return admit_batches(requests, ADMINISTRATOR).select("request_id", "events", "reason", "pos")
