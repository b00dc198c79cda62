"""Stored log segments, the log's key hash, keyed lateness and the overview's roll-up."""

import datetime as dt
import json

import pytest
from helpers import unordered
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions.measures import fnv1a, log_partition
from tidemark.functions.text import partition_key
from tidemark.operators.admission import ADMIN, TENANT_USER, Principal
from tidemark.operators.lateness import partition_marks
from tidemark.plans.apply import BatchOptions, apply_batch
from tidemark.plans.reader import Reader
from tidemark.plans.replay import rebuild
from tidemark.sources.archive import archive_rows, log_position, write_archive
from tidemark.sources.events import read_events_batch, read_events_stream, to_log_rows, write_log
from tidemark.sources.log import EVENT_LOG, append
from tidemark.sources.views import HotViews
from tidemark.streaming.native import stateful_lateness

OPTIONS = BatchOptions(block=fx.OFFSET_BLOCK, snapshot_seconds=0)


@pytest.fixture(scope="module")
def log(spark, sf):
    df = fx.telemetry(spark, sf).cache()
    df.count()
    return df


def numbered(log, first, last):
    """Messages of a dense log of 4 partitions, offsets from ``first`` to before ``last`` in each."""
    spark = log.sparkSession
    return spark.range((last - first) * 4).select(
        F.lit(b"k").alias("key"), F.col("id").cast("string").cast("binary").alias("value"), F.lit("t").alias("topic"),
        (F.col("id") % 4).cast("int").alias("partition"), (F.floor(F.col("id") / 4) + first).cast("long").alias("offset"),
        F.timestamp_seconds("id").alias("timestamp"), F.array().cast("array<struct<key string, value binary>>").alias("headers"))


def drained(stream, root, name="out"):
    query = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option(
        "checkpointLocation", f"{root}/cp-{name}").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()


def places(df):
    return sorted((r["partition"], r["offset"]) for r in df.collect())


def test_segments_are_read_by_offset(spark, log, tmp_path):
    path = str(tmp_path / "log")
    append(numbered(log, 0, 50), path)
    append(numbered(log, 50, 80), path)
    whole = read_events_batch(spark, EVENT_LOG, path=path)
    assert places(whole) == [(p, o) for p in range(4) for o in range(80)]
    assert {r["value"] for r in whole.select(F.col("value").cast("string").cast("int").alias("value")).collect()} == set(range(200))
    part = read_events_batch(spark, EVENT_LOG, {"startingOffsets": json.dumps({"0": 45, "1": 79, "2": 80}), "endingOffsets": json.dumps(
        {"0": 55, "1": 80, "2": 80, "3": 2})}, path)
    assert places(part) == [(0, o) for o in range(45, 55)] + [(1, 79), (3, 0), (3, 1)]
    assert read_events_batch(spark, EVENT_LOG, {"startingOffsets": "latest"}, path).count() == 0


def test_stream_starts_at_the_end_and_keeps_to_its_limit(spark, log, tmp_path):
    path = str(tmp_path / "log")
    append(numbered(log, 0, 10), path)

    def stream(limit):
        return read_events_stream(spark, EVENT_LOG, {"maxRowsPerTrigger": str(limit), "group": "one"}, path).select("partition", "offset")

    assert drained(stream(50), tmp_path) == []  # nothing is new yet
    append(numbered(log, 10, 40), path)
    sizes = drained(stream(50), tmp_path)
    assert sum(sizes) == 120 and max(sizes) <= 50 and len(sizes) >= 3
    append(numbered(log, 40, 60), path)
    # restarted with a smaller limit: nothing is lost, read again or over the limit
    sizes = drained(stream(20), tmp_path)
    assert sum(sizes) == 80 and max(sizes) <= 20
    read = spark.read.parquet(str(tmp_path / "out"))
    assert places(read) == [(p, o) for p in range(4) for o in range(10, 60)]
    with pytest.raises(Exception, match="needs a group"):
        drained(read_events_stream(spark, EVENT_LOG, {"maxRowsPerTrigger": "5"}, path), tmp_path, "none")


def test_few_rows_wait_for_the_delay(spark, log, tmp_path):
    path = str(tmp_path / "log")
    append(numbered(log, 0, 10), path)

    def sizes(name, **options):
        shown = {"startingOffsets": "earliest", "maxRowsPerTrigger": "60", "minRowsPerTrigger": "50", "group": name, **options}
        return drained(read_events_stream(spark, EVENT_LOG, shown, path), tmp_path, name)

    assert sizes("waits", maxTriggerDelay="3600") == [] and sizes("goes", maxTriggerDelay="0") == [40]
    append(numbered(log, 10, 15), path)
    assert sizes("waits", maxTriggerDelay="3600") == [60]


def test_stream_without_a_limit_takes_what_is_there(spark, log, tmp_path):
    path = str(tmp_path / "log")
    append(numbered(log, 0, 10), path)
    stream = read_events_stream(spark, EVENT_LOG, {"startingOffsets": "earliest"}, path)
    assert drained(stream, tmp_path) == [40]
    append(numbered(log, 10, 11), path)
    assert drained(stream, tmp_path) == [4]


def test_key_hash(spark):
    def client(key, n):  # the sum as a signed 32-bit number, its remainder without sign
        h = 2166136261
        for byte in key:
            h = (h ^ byte) * 16777619 & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h) % n

    keys = ["", "a", "foobar", "tenant_01:sensor_001", "ä:ß", "x" * 1000, *(f"tenant_{i}:s" for i in range(200))]
    found = spark.createDataFrame([(k,) for k in keys], "key string").select(
        "key", log_partition("key", 12).alias("text"), log_partition(F.col("key").cast("binary"), 7).alias("bytes"), fnv1a("key").alias("h")).collect()
    assert all((r["text"], r["bytes"]) == (client(r["key"].encode(), 12), client(r["key"].encode(), 7)) for r in found)
    # published test values of the hash
    assert {r["key"]: r["h"] for r in found if r["key"] in ("", "a", "foobar")} == {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}
    assert spark.sql("SELECT 1").select(log_partition(F.lit(b"\xff\x80\x00"), 12)).first()[0] == client(b"\xff\x80\x00", 12)


def test_published_partitions_go_on(spark, log, tmp_path):
    path = str(tmp_path / "log")
    for _ in range(2):
        write_log(to_log_rows(log), EVENT_LOG, {"partitions": "5"}, path)
    read = read_events_batch(spark, EVENT_LOG, path=path)
    per = read.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.count_distinct("offset").alias("d")).collect()
    assert sum(r["n"] for r in per) == 2 * log.count() and all(r["last"] + 1 == r["n"] == r["d"] for r in per)
    assert read.where(F.col("partition") != log_partition("key", 5)).count() == 0


def test_keyed_lateness_keeps_its_mark_in_state(spark, log, tmp_path):
    path = str(tmp_path / "log")
    first, rest = log.where(fx.before_cutover()), log.where(~fx.before_cutover())
    rest.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rest.schema).parquet(path)
    # small Arrow batches: a key's rows come in many frames
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        drained(stateful_lateness(stream, marks=partition_marks(first), block=fx.OFFSET_BLOCK), tmp_path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = fx.processed(spark, "/root/testdata/sf0.001").marked.where(~fx.before_cutover())
    columns = ["topic", "partition", "offset", "max_event_time", "late"]
    assert unordered(spark.read.parquet(str(tmp_path / "out")).select(*columns)) == unordered(want.select(*columns))

    def state(name):
        return spark.read.format("statestore").option("path", str(tmp_path / "cp-out")).option("stateVarName", name).load()

    marks = {(r["key"]["partition"]): r["value"]["ts"] for r in state("mark").collect()}
    assert marks == {r["partition"]: r["max_event_time"] for r in partition_marks(log).collect()}
    assert state("blocks").count() == 0  # blocks are gone once they are judged


def test_rebuild_by_key_hash_equals_live(spark, log, tmp_path):
    """A log whose partitions are those of its keys is rebuilt without being told the partitions."""
    keyed = log.withColumn("partition", log_partition(partition_key(), 12))
    views, root = HotViews(spark, str(tmp_path / "v"), claim_buckets=8), str(tmp_path / "archive")
    live = apply_batch(views, keyed, "run", 0, OPTIONS)
    before = unordered(views.read("event_windows"))
    write_archive(archive_rows(keyed, F.lit("not json"), F.col("log_time")), root)
    again = rebuild(views, root, "2024-01-01", "2024-01-02", [f"tenant_{i:02d}" for i in range(10)], "rebuild", 12)
    assert (again.recorded, again.late, again.duplicate) == (live.recorded, live.late, live.duplicate) and live.late
    assert unordered(views.read("event_windows")) == before


# ---- the overview's roll-up

def test_overview_from_the_roll_up_equals_the_views(spark, sf, log, tmp_path):
    views, root = HotViews(spark, str(tmp_path / "v"), claim_buckets=8), str(tmp_path / "archive")
    reader, admin, owner = Reader(views), Principal(ADMIN), Principal(TENANT_USER, "tenant_03")
    assert reader.overview(admin).first()["processed_total"] == 0
    apply_batch(views, log.where(fx.before_cutover()), "run", 0, OPTIONS)
    rejected = [(str(i), "decode_failed", None if i % 3 == 0 else f"tenant_0{i % 4}", None, "{}", dt.datetime(2024, 1, 1, 1, i)) for i in range(40)]
    views.write("rejection_events", spark.createDataFrame(rejected, "id string, reason string, tenant_id string, source_id string, payload string, "
                                                          "created_at timestamp"), "ingest", 0)
    views.write("service_state", fx.processor_rows(spark, sf).unionByName(fx.ingest_rows(spark, sf)), "ingest", 0)
    views.commit("ingest", 0)
    views.advance_overview("ingest", 0)
    apply_batch(views, log.where(~fx.before_cutover()), "run", 1, OPTIONS)

    def agree(*times):
        for who in (admin, owner):
            for at in times or ("2024-01-01 12:00:10",):
                now = F.lit(at).cast("timestamp")
                got, want = reader.overview(who, now).first().asDict(True), reader.overview_from_views(who, now).first().asDict(True)
                assert got == want, (who, at)

    agree("2024-01-01 11:59:59", "2024-01-01 12:00:10", "2024-01-01 12:30:00")
    assert reader.overview(admin, dt.datetime(2024, 1, 1, 12, 0, 10, tzinfo=dt.UTC)).first()["events_per_second_last_minute"] > 0
    # a repeated batch and another process change nothing
    assert not apply_batch(views, log, "run", 1, OPTIONS).applied
    views.compact()
    agree()
    views.reset_tenants(["tenant_03"])
    agree()
    write_archive(archive_rows(log, F.lit("not json"), F.col("log_time"), log_position()), root)
    rebuild(views, root, "2024-01-01", "2024-01-02", [f"tenant_{i:02d}" for i in range(10)], "rebuild", 12, block=OPTIONS.block)
    agree()
    assert len(views._overview_tables()) <= 3


def test_a_read_opens_two_minutes_and_one_table(spark, log, tmp_path):
    views = HotViews(spark, str(tmp_path / "v"), claim_buckets=8)
    apply_batch(views, log, "run", 0, OPTIONS)
    now = round(dt.datetime(2024, 1, 1, 11, 58, 20, tzinfo=dt.UTC).timestamp() * 1_000_000)
    early = views.overview_rows(now - 3_600_000_000)
    assert early is None  # answered from the views
    opened = {f.split("overview_")[1].split("/")[1] for f in views.overview_rows(now).inputFiles()}
    minute = now // 60_000_000
    newest = log.agg(F.max(F.floor(F.unix_micros("timestamp") / 60_000_000))).first()[0]
    current = f"at=000000000000.{newest}"
    assert {current} < opened <= {f"minute={minute - 1}", f"minute={minute}", current}
