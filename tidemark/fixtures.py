"""Telemetry inputs derived from the driver's ``events`` table.

The mapping compresses time 60 times (30 days into 12 hours) so windows fill, delays
some rows (late, or merely out of order) and delivers some twice. Every table row is
used. ``oracle.py`` states the same mapping in DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import TIME_FORMAT, encode_event, event_struct, partition_key
from tidemark.functions.timeparts import bucket_start
from tidemark.plans.process import Processed, process_batch
from tidemark.schemas import LOG_MESSAGE
from tidemark.session import prepare

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
CUTOVER_US = 1_704_088_800_000_000  # hour 6: shards replace the legacy table, instances restart
TOPIC = "telemetry.events"
LOG_PARTITIONS = 12
# Offsets follow arrival time with gaps, as in a compacted log: micros since the epoch,
# then 26 bits that keep rows of one microsecond apart.
OFFSET_BITS = 26
# Ten minutes of arrivals per scan block.
OFFSET_BLOCK = 600_000_000 << OFFSET_BITS


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrival log: telemetry events with log position and arrival time."""
    prepare(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us0"),
    )
    ts_us = F.lit(EPOCH_US) + F.floor((F.col("us0") - EPOCH_US) / 60).cast("bigint")
    delay = (
        F.when(F.col("event_id") % 11 == 0, F.lit(300_000_000))
        .when(F.col("event_id") % 7 == 0, F.lit(60_000_000)).otherwise(F.lit(0))
    )
    copies = F.sequence(F.lit(0), F.when(F.col("event_id") % 13 == 0, F.lit(1)).otherwise(F.lit(0)))
    rows = (
        events.withColumn("ts_us", ts_us)
        .withColumn("copy_no", F.explode(copies))
        .withColumn("arr_us", F.col("ts_us") + delay + F.col("copy_no") * 10_000_000)
    )
    user = F.col("user_id")
    offset = F.expr(
        f"shiftleft(arr_us - {EPOCH_US}L, {OFFSET_BITS}) + (event_id & 33554431L) * 2 + copy_no"
    )
    return rows.select(
        F.lit(1).cast("bigint").alias("schema_version"),
        F.concat(F.lit("evt-"), F.col("event_id")).alias("event_id"),
        F.concat(F.lit("tenant_"), F.lpad((user % 10).cast("string"), 2, "0")).alias("tenant_id"),
        F.concat(F.lit("sensor_"), F.lpad(user.cast("string"), 6, "0")).alias("source_id"),
        F.lit("telemetry").alias("event_type"),
        F.timestamp_micros("ts_us").alias("timestamp"),
        F.col("value").cast("double").alias("value"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn")
        .otherwise("ok").alias("status"),
        F.when(F.col("event_id") % 3 == 0, "us-east").when(F.col("event_id") % 3 == 1, "eu-west")
        .otherwise("ap-south").alias("region"),
        (F.col("event_id") + 1).alias("sequence"),
        F.lit(TOPIC).alias("topic"),
        (user % LOG_PARTITIONS).cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        F.timestamp_micros("arr_us").alias("log_time"),
        F.col("event_id").alias("n"),
        "copy_no",
    )


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the reference instant of all fixture queries, the latest event time."""
    return telemetry(spark, sf_dir).agg(F.max("timestamp").alias("as_of"))


def processed(spark: SparkSession, sf_dir: str) -> Processed:
    return process_batch(telemetry(spark, sf_dir), block=OFFSET_BLOCK)


def before_cutover() -> Column:
    return F.unix_micros("log_time") < CUTOVER_US


def log_messages(log: DataFrame) -> DataFrame:
    """The log as messages: key, JSON value, position, arrival time, no headers."""
    rows = log.withColumn("text", encode_event(event_struct()))
    return rows.select(
        partition_key().cast("binary").alias("key"), F.col("text").cast("binary").alias("value"), "topic", "partition", "offset",
        F.col("log_time").alias("timestamp"), F.array().cast(LOG_MESSAGE["headers"].dataType).alias("headers"))


# -- raw payloads: valid events, rule breakers and undecodable text -------------------


def broken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies, with one field spoiled in some rows; the first broken rule wins."""
    t, n = telemetry(spark, sf_dir).where("copy_no = 0"), F.col("n")
    return (
        t.withColumn("schema_version", F.when(n % 29 == 0, F.lit(99)).otherwise(F.col("schema_version")))
        .withColumn("tenant_id", F.when(n % 17 == 0, F.lit("  ")).otherwise(F.col("tenant_id")))
        .withColumn("source_id", F.when(n % 31 == 0, F.lit("")).otherwise(F.col("source_id")))
        .withColumn("status", F.when(n % 19 == 0, F.lit("bad")).otherwise(F.col("status")))
        .withColumn("sequence", F.when(n % 23 == 0, F.lit(0).cast("bigint")).otherwise(F.col("sequence")))
    )


def _element_text(event: Column) -> Column:
    """JSON of an event; some get a field the schema lacks, some a text for the number."""
    n, text = F.col("n"), encode_event(event)
    text = F.when(n % 41 == 0, F.regexp_replace(text, r"\}$", ',"extra":"boom"}')).otherwise(text)
    return F.when(n % 43 == 0, F.regexp_replace(text, r'"value":[^,]+', '"value":"x"')).otherwise(text)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kafka-shaped messages; some end early, some have text after the document."""
    n, text = F.col("n"), F.col("text")
    rows = broken_events(spark, sf_dir).withColumn("text", _element_text(event_struct()))
    text = F.when(n % 37 == 0, F.substring("text", 1, 20)).when(n % 47 == 0, F.concat("text", F.lit(" tail"))).otherwise(text)
    return rows.select(
        F.concat_ws(":", "tenant_id", "source_id").cast("binary").alias("key"), text.cast("binary").alias("value"),
        "topic", "partition", "offset", "log_time",
        F.array(F.struct(F.lit("trace").alias("key"), n.cast("string").cast("binary").alias("value"))).alias("headers"),
        "n",
    )


REQUEST_EVENTS = 4


def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-array bodies of four consecutive events each."""
    rows = broken_events(spark, sf_dir).select(
        F.floor(F.col("n") / REQUEST_EVENTS).cast("bigint").alias("request_id"), "n", "log_time",
        _element_text(event_struct()).alias("text"),
    )
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return rows.groupBy("request_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["text"]), ","), F.lit("]")).alias("body"),
        F.max("log_time").alias("received_at"),
    )


# -- service state and metric samples -----------------------------------------------


def instance_id() -> Column:
    return F.concat(F.lit("proc-"), F.col("partition") % 3)


def processor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``service_state`` rows of three processor replicas, from per-partition progress."""
    p = processed(spark, sf_dir)
    spread = p.marked.groupBy("partition").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    parts = p.progress.join(spread, "partition").withColumn("instance_id", instance_id())
    listed = F.sort_array(F.collect_list(F.struct(
        "partition", F.col("duplicate_total").alias("lag"), "processed_total", "duplicate_total", "late_event_total",
        F.lit(0).cast("bigint").alias("inflight_messages"), "last_offset", "last_seen_at")))
    totals = [F.sum(c).alias(c) for c in ("processed_total", "duplicate_total", "late_event_total")]
    states = parts.groupBy("instance_id").agg(
        *totals, F.sum("duplicate_total").alias("consumer_lag"), F.count(F.lit(1)).alias("active_partitions"),
        F.min("lo").alias("processing_p50_ms"), F.max("hi").alias("processing_p95_ms"),
        (F.max("hi") + 1).alias("processing_p99_ms"), listed.alias("partitions"), F.max("last_seen_at").alias("updated_at"),
    )
    body = [c for c in states.columns if c not in ("instance_id", "updated_at")]
    return states.select(
        F.lit("stream-processor").alias("service_name"), "instance_id",
        F.to_json(F.struct(*body), {"timestampFormat": TIME_FORMAT}).alias("payload"), "updated_at",
    )


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``service_state`` rows of ingest replicas, one per region."""
    t = telemetry(spark, sf_dir)
    return t.groupBy(F.concat(F.lit("ingest-"), F.col("region")).alias("instance_id")).agg(
        F.count_if(F.col("status") != "error").alias("accepted_total"),
        F.count_if(F.col("status") == "error").alias("rejected_total"), F.max("log_time").alias("updated_at"),
    ).select(
        F.lit("ingest-service").alias("service_name"), "instance_id",
        F.to_json(F.struct("accepted_total", "rejected_total")).alias("payload"), "updated_at",
    )


def minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals and outcomes per minute and instance."""
    p = processed(spark, sf_dir)
    minute = bucket_start("log_time", 60).alias("sample_ts")
    arrived = p.marked.groupBy(minute, instance_id().alias("instance_id")).agg(
        F.count(F.lit(1)).alias("arrived"), F.max("value").alias("peak"))
    kept = p.winners.groupBy(minute, instance_id().alias("instance_id")).agg(
        F.count_if(~F.col("late")).alias("recorded"), F.count_if("late").alias("late"))
    zero = F.lit(0).cast("bigint")
    return arrived.join(kept, ["sample_ts", "instance_id"], "left").select(
        "sample_ts", "instance_id", "arrived", "peak", F.coalesce("recorded", zero).alias("recorded"),
        F.coalesce("late", zero).alias("late"),
        (F.col("arrived") - F.coalesce("recorded", zero) - F.coalesce("late", zero)).alias("duplicate"),
    )


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative processed counter per minute and instance; all restart at the cutover."""
    life = Window.partitionBy("instance_id", (F.unix_micros("sample_ts") < CUTOVER_US)).orderBy("sample_ts")
    return minute_counts(spark, sf_dir).select(
        "instance_id", "sample_ts", F.sum("recorded").over(life).cast("double").alias("value"))


def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table ``(run_id, sample_ts, metric, value)``: each hour is a run."""
    per_minute = minute_counts(spark, sf_dir).groupBy("sample_ts").agg(
        *[F.sum(c).alias(c) for c in ("arrived", "recorded", "late", "duplicate")], F.max("peak").alias("peak"))
    run = F.concat(F.lit("run-"), F.date_format("sample_ts", "HH"))
    order = Window.partitionBy("run_id").orderBy("sample_ts")
    totals = per_minute.withColumn("run_id", run).select(
        "run_id", "sample_ts", "peak",
        F.sum("arrived").over(order).alias("archived"), F.sum("recorded").over(order).alias("recorded"),
        F.sum("duplicate").over(order).alias("duplicate"), F.sum("late").over(order).alias("late"),
        (F.col("late") + F.col("duplicate")).alias("lag"),
    )
    return totals.select("run_id", "sample_ts", F.explode(F.create_map(
        F.lit("archived_total"), F.col("archived").cast("double"),
        F.lit("accepted_total"), (F.col("archived") - F.col("late")).cast("double"),
        F.lit("publish_failed_total"), F.col("late").cast("double"),
        F.lit("processed_total"), F.col("recorded").cast("double"),
        F.lit("duplicate_total"), F.col("duplicate").cast("double"),
        F.lit("rejected_total"), F.col("late").cast("double"),
        F.lit("sent_total"), (F.col("archived") + F.col("late")).cast("double"),
        F.lit("failed_total"), F.col("late").cast("double"),
        F.lit("consumer_lag"), F.col("lag").cast("double"),
        F.lit("processing_p95_ms"), F.col("peak"),
    )).alias("metric", "value"))


VALUE_BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, float("inf"))


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram buckets per minute: ``(instance_id, stage, sample_ts, le, value)``."""
    t = telemetry(spark, sf_dir).withColumn("instance_id", instance_id())
    counts = t.groupBy("instance_id", F.col("status").alias("stage"), bucket_start("log_time", 60).alias("sample_ts")).agg(
        *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(VALUE_BOUNDS)])
    order = Window.partitionBy("instance_id", "stage").orderBy("sample_ts")
    totals = counts.select("instance_id", "stage", "sample_ts", *[
        F.sum(f"b{i}").over(order).cast("double").alias(f"b{i}") for i in range(len(VALUE_BOUNDS))])
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("value")) for i, b in enumerate(VALUE_BOUNDS)])
    return totals.select("instance_id", "stage", "sample_ts", F.explode(pairs).alias("p")).select(
        "instance_id", "stage", "sample_ts", "p.le", "p.value")
