"""Variants on Spark's own watermark and state store."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.measures import measures
from tidemark.operators.dedup import dedup_within
from tidemark.operators.lateness import OFFSETS_PER_BLOCK


def native_windows(stream: DataFrame, seconds: int = 60, lateness: str = "2 minutes", dedup_for: str | None = None) -> DataFrame:
    """Tumbling windows under one global watermark; rows behind it are dropped."""
    rows = dedup_within(stream, dedup_for) if dedup_for else stream.withWatermark("timestamp", lateness)
    return (
        rows.groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), "tenant_id", "source_id")
        .agg(*measures("max_event_at"))
        .select(F.lit(seconds).alias("window_size_seconds"), F.col("w.start").alias("window_start"), "tenant_id",
                "source_id", "events_count", "ok_count", "warn_count", "error_count", "value_sum", "max_event_at")
    )


LATENESS_COLUMNS = ("topic", "partition", "offset", "log_time", "event_id", "tenant_id", "source_id", "timestamp")
LATENESS_OUTPUT = (
    "topic string, partition int, offset bigint, log_time timestamp, event_id string, tenant_id string, source_id string, "
    "timestamp timestamp, max_event_time timestamp, late boolean")


def _packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class LatenessProcessor(StatefulProcessor):
    """High-water mark per log partition as keyed state.

    Rows of a micro-batch arrive unordered, in frames. Each frame is cut by offset block and laid down in map state; when
    all frames are in, the blocks are taken in order, one at a time, and their rows judged against the running mark. What is in
    memory is one frame or one block, however long the micro-batch. The mark starts from the stored marks, if given.
    """

    def __init__(self, lateness_seconds: float = 120.0, block: int = OFFSETS_PER_BLOCK):
        self.allowed, self.block = pd.Timedelta(seconds=lateness_seconds), block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "ts timestamp")
        self.blocks = handle.getMapState("blocks", "block long, piece int", "rows binary")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        highest = initialState["max_event_time"].max()
        if pd.notna(highest):
            self.mark.update((highest.to_pydatetime(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pieces: dict[int, int] = {}
        for frame in rows:
            for block, part in frame.groupby(frame["offset"] // self.block):
                number = pieces[block] = pieces.get(block, 0) + 1
                self.blocks.updateValue((int(block), number), (_packed(part),))
        mark = pd.Timestamp(self.mark.get()[0]) if self.mark.exists() else None
        for block in sorted(pieces):
            keys = [(int(block), number) for number in range(1, pieces[block] + 1)]
            inside = pa.concat_tables(_unpacked(self.blocks.getValue(k)[0]) for k in keys).sort_by("offset").to_pandas()
            for k in keys:
                self.blocks.removeKey(k)
            running = inside["timestamp"].cummax()
            running = running if mark is None else running.clip(lower=mark)
            mark = running.iloc[-1]
            yield inside.assign(topic=key[0], partition=key[1], max_event_time=running, late=inside["timestamp"] < running - self.allowed)[
                [*LATENESS_COLUMNS, "max_event_time", "late"]]
        if mark is not None:
            self.mark.update((mark.to_pydatetime(),))

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IN_MEMORY, _ROCKSDB = (f"org.apache.spark.sql.execution.streaming.state.{name}StateStoreProvider" for name in ("HDFSBacked", "RocksDB"))


def stateful_lateness(
    stream: DataFrame, lateness_seconds: float = 120.0, marks: DataFrame | None = None, block: int = OFFSETS_PER_BLOCK,
) -> DataFrame:
    """Log rows with their partition's mark and whether they are late; ``marks`` are those stored by an earlier run.

    Spark's default state store cannot hold several states of a processor. A session that has it is set to RocksDB; a stream
    goes on with the store named in its checkpoint.
    """
    conf = stream.sparkSession.conf
    if conf.get(PROVIDER) == _IN_MEMORY:
        conf.set(PROVIDER, _ROCKSDB)
    rows = stream.select(*LATENESS_COLUMNS)
    return rows.groupBy("topic", "partition").transformWithStateInPandas(
        statefulProcessor=LatenessProcessor(lateness_seconds, block), outputStructType=LATENESS_OUTPUT, outputMode="Append",
        timeMode="None", initialState=None if marks is None else marks.select("topic", "partition", "max_event_time").groupBy("topic", "partition"),
    )
