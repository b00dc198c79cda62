"""The streaming jobs: requests to log, log to hot views."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.admission import Principal, admit_batches, admitted_events
from tidemark.operators.deadletters import dead_letter_log
from tidemark.operators.rejections import to_rejections
from tidemark.operators.state import INGEST
from tidemark.plans.apply import BatchOptions, EndOffsets, apply_messages
from tidemark.schemas import INGEST_STATE
from tidemark.session import prepare, shared_dir
from tidemark.sources.archive import archive_rows, position, write_archive
from tidemark.sources.events import to_log_rows, write_log
from tidemark.sources.views import HotViews

FLUSH_INTERVAL = "100 milliseconds"


def stream_run(run_id: str, query_id: str) -> str:
    """The run under which a stream commits: its name and the id that its checkpoint holds.

    Batch numbers start anew with a new checkpoint, so commits of another checkpoint must not count for it.
    """
    return f"{run_id}.{query_id}"


def _run_of(run_id: str, batch: DataFrame) -> str:
    return stream_run(run_id, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))


def _start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None, interval: str | None, name: str) -> StreamingQuery:
    writer = df.writeStream.queryName(name).foreachBatch(handle).option(
        "checkpointLocation", checkpoint or shared_dir(df.sparkSession, "streams", name)
    )
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def dead_letter_publisher(fmt: str, options: Mapping[str, str] = {}, path: str | None = None):
    """Sink for dead letters: the log format of choice, one folder per batch for files."""
    def publish(letters: DataFrame, batch_id: int) -> None:
        rows = dead_letter_log(letters)
        if fmt == "kafka":
            rows.drop("timestamp").write.format("kafka").options(**{"includeHeaders": "true", **options}).save()
        else:
            rows.write.format(fmt).mode("overwrite").options(**options).save(f"{path}/batch={batch_id}")
    return publish


def start_processor(
    messages: DataFrame, views: HotViews, checkpoint: str | None = None, run_id: str = "stream",
    options: BatchOptions = BatchOptions(), interval: str | None = FLUSH_INTERVAL, publish_dead_letters=None, fault=None,
    end_offsets: EndOffsets | None = None,
) -> StreamingQuery:
    """Fold the log into the hot views.

    The checkpoint advances only after the batch is committed to the views and its dead
    letters are published; any failure stops the query and the batch is repeated. The
    source's ``maxOffsetsPerTrigger`` bounds a batch, ``interval=None`` drains and stops.
    Without ``checkpoint`` the state goes below the cluster's ``spark.checkpoint.dir``. A new
    checkpoint is a new run: nothing of it is skipped, and ids claimed earlier stay claimed.
    """
    prepare(views.spark)

    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_messages(
            views.on(batch.sparkSession), batch, _run_of(run_id, batch), batch_id, options, publish_dead_letters, fault, end_offsets)

    return _start(messages, handle, checkpoint, interval, f"{run_id}-processor")


@dataclass(frozen=True)
class IngestTotals:
    """What an ingest instance has accepted (events) and rejected (requests) since it first ran."""

    accepted: int = 0
    rejected: int = 0
    since: float = 0.0

    def add(self, accepted: int, rejected: int) -> IngestTotals:
        return IngestTotals(self.accepted + accepted, self.rejected + rejected, self.since)

    def row(self, spark: SparkSession, instance_id: str) -> DataFrame:
        payload = json.dumps({"accepted_total": self.accepted, "rejected_total": self.rejected, "uptime_seconds": int(time.time() - self.since)})
        return spark.createDataFrame([(INGEST, instance_id, payload)], "service_name string, instance_id string, payload string").withColumn(
            "updated_at", F.current_timestamp())


def _totals(views: HotViews, instance_id: str) -> IngestTotals:
    """The instance's totals as of the last commit: held by its process, or read from the stored state once after a start."""
    held = views.held("ingest")
    if instance_id not in held:
        state = F.from_json("payload", INGEST_STATE)
        last = views.read("service_state").where((F.col("service_name") == INGEST) & (F.col("instance_id") == instance_id)).select(
            F.coalesce(state["accepted_total"], F.lit(0)), F.coalesce(state["rejected_total"], F.lit(0))).first()
        held[instance_id] = IngestTotals(*(last or (0, 0)), since=time.time())
    return held[instance_id]


def ingest_requests(
    requests: DataFrame, principal: Principal, views: HotViews, archive_root: str, log_format: str, log_options: Mapping[str, str],
    log_path: str | None, run_id: str, batch_id: int, key: str = "request_id", instance_id: str = "ingest-0",
) -> None:
    """Admit batch requests, record rejections, archive and publish what was admitted.

    The commit comes last: a batch that is committed is done, any other is repeated whole. Archive and publish may
    then repeat; dedup by event id makes that safe. The batch's accepted events and rejections are observed on its own
    writes and added to the instance's totals, which are committed with it as service state.
    """
    views = views.on(requests.sparkSession)
    if views.committed(run_id) >= batch_id:
        return
    kept = requests.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        verdicts = admit_batches(kept, principal, key)
        now, accepted, rejected = F.current_timestamp(), Observation(), Observation()
        views.write("rejection_events", to_rejections(verdicts.where("reason IS NOT NULL"), F.col("payload"), now, F.col(key)).observe(
            rejected, F.count(F.lit(1)).alias("n")), run_id, batch_id)
        events = admitted_events(kept, principal, key)
        stood = position(request=F.col(key), pos=F.col("pos"))
        write_archive(archive_rows(events, F.col("raw_payload"), now, stood), archive_root)
        # a source's events reach the log in the order that the archive tells
        ordered = events.repartition("tenant_id", "source_id").sortWithinPartitions(key, "pos")
        write_log(to_log_rows(ordered).observe(accepted, F.count(F.lit(1)).alias("n")), log_format, log_options, log_path)
        totals = _totals(views, instance_id).add(accepted.get["n"], rejected.get["n"])
        views.write("service_state", totals.row(views.spark, instance_id), run_id, batch_id)
        views.commit(run_id, batch_id)
        views.held("ingest")[instance_id] = totals
        views.advance_overview(run_id, batch_id)
    finally:
        kept.unpersist()


def start_ingest(
    requests: DataFrame, principal: Principal, views: HotViews, archive_root: str, checkpoint: str | None, log_format: str,
    log_options: Mapping[str, str] = {}, log_path: str | None = None, run_id: str = "ingest", interval: str | None = FLUSH_INTERVAL,
) -> StreamingQuery:
    run = partial(
        ingest_requests, principal=principal, views=views, archive_root=archive_root, log_format=log_format,
        log_options=log_options, log_path=log_path)
    return _start(
        requests, lambda batch, batch_id: run(batch, run_id=_run_of(run_id, batch), batch_id=batch_id), checkpoint, interval, run_id)
