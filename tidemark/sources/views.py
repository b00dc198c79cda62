"""Hot views kept as additive deltas in plain parquet.

Each batch writes its own folder ``<view>/run_id=<run>/batch_id=<n>``; nothing is updated
in place, so a repeated batch just rewrites its folder. A commit row, appended after all
views of the batch are written, makes the batch visible: readers take only committed
batches, so the views of one batch appear together. Reads merge deltas (sum, max).
Compaction folds the committed deltas into one snapshot run and says so in its own commit
row. There is one writer at a time per root.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.aggregates import rollup
from tidemark.operators.state import latest_state
from tidemark.schemas import VIEWS
from tidemark.sources import overview

CLAIM_BUCKETS = 256
BUCKETED = "processed_events_by_bucket"
_COMMIT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("run_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    # for a snapshot: the run's batches up to this one are folded into it
    T.StructField("folded", T.MapType(T.StringType(), T.LongType())),
])
_SUMS = ["events_count", "ok_count", "warn_count", "error_count", "value_sum"]
# view -> (keys, sums, maxima); of service_state the newest row per instance counts,
# the other views are plain appends
MERGE: dict[str, tuple[list[str], list[str], list[str]]] = {
    "tenant_metrics": (["bucket_start", "tenant_id"], _SUMS, ["last_event_at"]),
    "tenant_metric_shards": (["bucket_start", "tenant_id", "shard_id"], _SUMS, ["last_event_at"]),
    "source_metrics": (["tenant_id", "source_id"], ["events_count"], ["last_event_at"]),
    "event_windows": (
        ["window_size_seconds", "window_start", "tenant_id", "source_id"], _SUMS, ["max_event_at"]),
    "partition_marks": (["topic", "partition"], [], ["max_event_time"]),
    "partition_progress": (
        ["topic", "partition"], ["processed_total", "duplicate_total", "late_event_total"],
        ["last_offset", "last_seen_at"]),
}


@dataclass
class HotViews:
    """Views below one root folder on shared storage."""

    spark: SparkSession
    root: str
    claim_buckets: int = CLAIM_BUCKETS
    # the writer's own view of the commit log; readers start empty and load it once
    _log: dict = field(default_factory=dict, repr=False)
    # commit rows that wait for the next commit
    _pending: list = field(default_factory=list, repr=False)

    def on(self, spark: SparkSession) -> HotViews:
        """The same views through another session (streaming batches run in a clone)."""
        return HotViews(spark, self.root, self.claim_buckets, self._log)

    def refresh(self) -> HotViews:
        """Forget the loaded commit log, to see what another writer committed since."""
        self._log.pop("state", None)
        return self

    def held(self, what: str) -> dict:
        """What the writing process keeps between batches."""
        return self._log.setdefault(what, {})

    def snapshot_due(self, every_seconds: float | None) -> bool:
        """Whether the writer should record its state again."""
        now = time.monotonic()
        if every_seconds is None or now - self._log.get("snapshot", float("-inf")) < every_seconds:
            return False
        self._log["snapshot"] = now
        return True

    # -- commits ---------------------------------------------------------------
    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _commits(self) -> tuple[str | None, dict[str, int], dict[str, int], int]:
        """Current snapshot run, its folded positions, committed position per run, next number.

        Reads one row per run and one per compaction, never data.
        """
        if "state" not in self._log:
            self._log["state"] = self._load_commits()
        return self._log["state"]

    def _load_commits(self) -> tuple[str | None, dict[str, int], dict[str, int], int]:
        path = f"{self.root}/_commits"
        if not self._exists(path):
            return None, {}, {}, 0
        log = self.spark.read.schema(_COMMIT).parquet(path)
        heads = log.groupBy("run_id").agg(
            F.max("batch_id").alias("head"), F.max("seq").alias("seq"), F.max_by("folded", "seq").alias("folded")
        ).collect()
        snapshots = [r for r in heads if r["folded"] is not None]
        latest = max(snapshots, key=lambda r: r["seq"], default=None)
        committed = {r["run_id"]: r["head"] for r in heads if r["folded"] is None}
        next_seq = max((r["seq"] for r in heads), default=-1) + 1
        return (latest["run_id"], dict(latest["folded"]), committed, next_seq) if latest else (None, {}, committed, next_seq)

    def committed(self, run_id: str) -> int:
        """Last committed batch of a run, -1 before the first."""
        return self._commits()[2].get(run_id, -1)

    def commit(self, run_id: str, batch_id: int, folded: dict[str, int] | None = None) -> None:
        snapshot, held, committed, seq = self._commits()
        rows = [*self._pending, (seq, run_id, batch_id, folded)]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.root}/_commits"
        )
        self._pending.clear()
        # the writer knows what it wrote: the log is not read again for it
        self._log["state"] = (
            (snapshot, held, {**committed, run_id: batch_id}, seq + 1) if folded is None else (run_id, dict(folded), committed, seq + 1))

    # -- deltas ----------------------------------------------------------------
    def write(self, view: str, df: DataFrame, run_id: str, batch_id: int) -> None:
        """(Re)write one batch's rows of a view; invisible until committed.

        Views that are read by tenant and time are sorted by them, so that a read skips the files and
        row groups of other tenants and times by their statistics.
        """
        target = f"{self.root}/{view}/run_id={run_id}/batch_id={batch_id}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in VIEWS[view].fields])
        order = [c for c in ("tenant_id", "bucket_start", "window_start") if c in rows.columns]
        (rows.sortWithinPartitions(*order) if len(order) > 1 else rows).write.mode("overwrite").parquet(target)

    def _write_snapshot(self, view: str, df: DataFrame, run: str) -> None:
        """Snapshots of claims are foldered by bucket; batches stay a few files each."""
        if view != "processed_events":
            return self.write(view, df, run, 0)
        df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{BUCKETED}/run_id={run}")
        return None

    def deltas(self, view: str) -> DataFrame:
        """Visible rows before merging, with ``run_id`` and ``batch_id``."""
        schema = T.StructType([
            *VIEWS[view].fields, T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())])
        snapshot, folded, committed, _ = self._commits()
        if not self._exists(f"{self.root}/{view}"):
            return self.spark.createDataFrame([], schema)
        run, batch = F.col("run_id"), F.col("batch_id")
        visible: Column = (run == snapshot) if snapshot else F.lit(False)
        for name, head in committed.items():
            visible = visible | ((run == name) & (batch > folded.get(name, -1)) & (batch <= head))
        # run_id and batch_id are folder names, so this prunes whole folders
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{view}").where(visible)
        if view == "processed_events" and snapshot:
            rows = rows.unionByName(self._claims_snapshot(snapshot).withColumns(
                {"run_id": F.lit(snapshot), "batch_id": F.lit(0).cast("bigint")}))
        return rows

    def _claims_snapshot(self, run: str) -> DataFrame:
        return self.spark.read.schema(VIEWS["processed_events"]).parquet(f"{self.root}/{BUCKETED}/run_id={run}")

    def read(self, view: str) -> DataFrame:
        """The view as of the last commit, deltas merged."""
        rows = self.deltas(view).select(*VIEWS[view].fieldNames())
        if view in MERGE:
            keys, sums, maxima = MERGE[view]
            return rollup(rows, keys, sums, maxima).select(*VIEWS[view].fieldNames())
        if view == "service_state":
            return latest_state(rows).select(*VIEWS[view].fieldNames())
        return rows

    # -- claims ----------------------------------------------------------------
    def claim_bucket(self, event_id: str = "event_id") -> Column:
        return F.pmod(F.xxhash64(event_id), F.lit(self.claim_buckets)).cast("int")

    def claimed_among(self, ids: DataFrame) -> DataFrame:
        """Which of these ids are claimed already.

        ``ids`` should be cached: Spark then knows its size and, when small, broadcasts
        it so the claim table streams past without a shuffle, and of the snapshot reads
        only the buckets that occur (the filter on ``bucket`` enables that pruning). A
        large batch becomes a shuffled semi join by itself.
        """
        wanted = ids.select("event_id", self.claim_bucket().alias("bucket")).where("bucket >= 0")
        snapshot = self._commits()[0]
        recent = self.deltas("processed_events")
        if snapshot:
            recent = recent.where(F.col("run_id") != snapshot)
        parts = [recent] + ([self._claims_snapshot(snapshot)] if snapshot else [])
        hits = [p.select("event_id", "bucket").join(wanted, ["bucket", "event_id"], "left_semi").select("event_id") for p in parts]
        return hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])

    # -- the dashboard's roll-up -------------------------------------------------
    def write_minutes(self, grain: DataFrame, run_id: str, batch_id: int) -> int | None:
        """(Re)write what a batch adds to its newest minutes, and give the last; partitions of other batches stay as they are."""
        seen = Observation()
        rows = overview.minute_rows(grain).withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id)})
        self._overwrite_minutes(rows.observe(seen, F.max("minute").alias("newest")))
        return seen.get["newest"]

    def _overwrite_minutes(self, rows: DataFrame) -> None:
        rows.hint("rebalance", "minute").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "minute", "run_id", "batch_id").parquet(f"{self.root}/{overview.MINUTES}")

    def advance_overview(self, run_id: str | None = None, batch_id: int = 0, newest: int | None = None) -> None:
        """Write the current table of the last commit: the one before and the batch, or else all views.

        ``newest`` is the last minute that the batch wrote.
        """
        last, base, tables = self._commits()[3] - 1, f"{self.root}/{overview.CURRENT}", self._overview_tables()
        newest = max([minute for _, minute in tables] + [newest or 0])
        makers = {"source_metrics": overview.total_rows, "rejection_events": overview.rejection_rows, "service_state": overview.state_rows}
        before = [f"{base}/at={at:012d}.{minute}" for at, minute in tables if at == last - 1]
        if run_id is not None and before:
            rows = self.spark.read.schema(overview.ROW).parquet(before[-1])
            for view, made in makers.items():
                path = f"{self.root}/{view}/run_id={run_id}/batch_id={batch_id}"
                if self._exists(path):
                    rows = rows.unionByName(made(self.spark.read.schema(VIEWS[view]).parquet(path)))
            rows = rows.coalesce(1)  # small, and in one task nothing is shuffled
        else:
            parts = [made(self.read(view)) for view, made in makers.items()]
            rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
        overview.folded(rows).coalesce(1).write.mode("overwrite").parquet(f"{base}/at={last:012d}.{newest}")
        for at, minute in tables:
            if at < last - 2:  # a reader may still be at the ones before
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/at={at:012d}.{minute}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _overview_tables(self) -> list[tuple[int, int]]:
        """Commit and newest minute of the finished current tables, a few at any time."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{overview.CURRENT}/at=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        names = [f.getPath().getParent().getName().removeprefix("at=").split(".") for f in found]
        return sorted((int(at), int(minute)) for at, minute in names)

    def overview_rows(self, now_us: int) -> DataFrame | None:
        """Roll-up rows for an overview at this time: two minutes and the newest current table.

        None before the first, and for a time whose minutes the roll-up does not keep.
        """
        tables, minute = self._overview_tables(), now_us // overview.MINUTE_US
        if not tables or minute - 1 <= tables[-1][1] - overview.KEPT_MINUTES:
            return None
        minutes = {(now_us - overview.MINUTE_US) // overview.MINUTE_US, minute}
        paths = [p for m in sorted(minutes) if self._exists(p := f"{self.root}/{overview.MINUTES}/minute={m}")]
        paths.append(f"{self.root}/{overview.CURRENT}/at={tables[-1][0]:012d}.{tables[-1][1]}")
        return self.spark.read.schema(overview.ROW).option("recursiveFileLookup", "true").parquet(*paths)

    def forget_minutes(self, tenant_ids: Sequence[str], but_run: str = "") -> None:
        """Take the tenants out of the minutes that hold them, but for one run's; a partition left empty keeps a row of nothing."""
        if not self._exists(f"{self.root}/{overview.MINUTES}"):
            return
        part = [T.StructField("minute", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())]
        rows = self.spark.read.schema(T.StructType([*overview.ROW.fields, *part])).parquet(f"{self.root}/{overview.MINUTES}")
        keys = ["minute", "run_id", "batch_id"]
        theirs = F.col("tenant_id").isin(list(tenant_ids)) & (F.col("run_id") != but_run)
        held = rows.where(theirs).select(*keys).distinct()
        nothing = held.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in overview.ROW.fields], *keys)
        self._overwrite_minutes(rows.where(~theirs | F.col("tenant_id").isNull()).join(held, keys, "left_semi").unionByName(nothing))

    # -- maintenance -----------------------------------------------------------
    def compact(self, keep: Callable[[str], Column] | None = None) -> str:
        """Fold all committed deltas into one snapshot; ``keep(view)`` filters rows on the way.

        One commit state holds for the whole compaction: what is committed meanwhile is neither
        folded nor counted as folded.
        """
        run, folded = self._fold(keep)
        self.commit(run, 0, folded)
        self.advance_overview()
        return run

    def _fold(self, keep: Callable[[str], Column] | None) -> tuple[str, dict[str, int]]:
        """Write a snapshot that no commit row names yet."""
        _, folded, committed, seq = self._commits()
        run = f"snapshot-{seq:012d}-{uuid.uuid4().hex[:8]}"
        for view in VIEWS:
            if not self._exists(f"{self.root}/{view}"):
                continue
            rows = self.read(view)
            if keep is not None:
                rows = rows.where(keep(view))
            self._write_snapshot(view, rows, run)
        return run, {**folded, **committed}

    def reset_tenants(self, tenant_ids: Sequence[str]) -> str:
        """Forget the tenants' hot rows, claims, shards and windows."""
        self.forget_minutes(tenant_ids)
        return self.compact(self._without(tenant_ids))

    def as_if_reset(self, tenant_ids: Sequence[str]) -> HotViews:
        """The views without the tenants' rows, for one batch.

        Others see the reset only with the first commit made through the result, in the same
        commit file: if that never comes, nothing was reset.
        """
        _, _, committed, seq = self._commits()
        run, folded = self._fold(self._without(tenant_ids))
        state = {"state": (run, folded, committed, seq + 1)}
        return HotViews(self.spark, self.root, self.claim_buckets, state, [(seq, run, 0, folded)])

    @staticmethod
    def _without(tenant_ids: Sequence[str]) -> Callable[[str], Column]:
        def keep(view: str) -> Column:
            if "tenant_id" in VIEWS[view].fieldNames() and view not in ("rejection_events", "dead_letters"):
                return ~F.coalesce(F.col("tenant_id").isin(list(tenant_ids)), F.lit(False))
            return F.lit(True)

        return keep
