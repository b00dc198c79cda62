"""Stored log segments as a Spark data source: partitions, offsets, a latest start and a row limit per trigger.

A log is a folder ``partition=<p>/<first offset>.parquet`` of segments whose rows stand in offset order, as exported from a
broker or written by ``append``. Offsets may have gaps. A batch read takes one task a segment; a stream's offsets are, for
each partition, the first offset not yet read. What the driver reads to plan a micro-batch are footers and, with a row
limit, the offset column of the segments that the limit reaches.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from tidemark.functions.measures import log_partition

EVENT_LOG = "event_log"
SEGMENT_ROWS = 200_000
GROUP_BYTES = 4 << 20  # what a writing task holds, and a reading one decodes from, beside the batch in hand
_SCHEMA = ("key binary, value binary, topic string, partition int, offset long, timestamp timestamp, "
           "headers array<struct<key string, value binary>>")
_NAMES = ["key", "value", "topic", "partition", "offset", "timestamp", "headers"]


@dataclass
class Span(InputPartition):
    """Rows of some segments of a partition, from ``start`` up to but not including ``end``."""

    files: list[str]
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: temporary and final path."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class Segments:
    """What a log folder holds."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path)

    def files(self) -> dict[int, list[tuple[int, str]]]:
        """(first offset, path) of every segment, by partition and in order."""
        found: dict[int, list[tuple[int, str]]] = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            folder, _, name = info.path.rpartition("/")
            if name.endswith(".parquet") and folder.rpartition("/")[2].startswith("partition="):
                found.setdefault(int(folder.rpartition("=")[2]), []).append((int(name.removesuffix(".parquet")), info.path))
        return {p: sorted(found[p]) for p in sorted(found)}

    def offsets(self, file: str) -> pa.ChunkedArray:
        with self.fs.open_input_file(file) as source:
            return pq.ParquetFile(source).read(columns=["offset"])["offset"]

    def end(self, file: str) -> int:
        """One past the last offset of a segment, from its footer."""
        with self.fs.open_input_file(file) as source:
            meta = pq.ParquetFile(source).metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "offset")
        statistics = meta.row_group(meta.num_row_groups - 1).column(column).statistics
        return (statistics.max if statistics and statistics.has_min_max else self.offsets(file)[-1].as_py()) + 1

    def ends(self, files: dict[int, list[tuple[int, str]]] | None = None) -> dict[str, int]:
        return {str(p): self.end(parts[-1][1]) for p, parts in (self.files() if files is None else files).items()}

    def place(self, wanted: str, ends: dict[str, int]) -> dict[str, int]:
        """``earliest``, ``latest`` or a JSON object of offsets by partition."""
        if wanted == "earliest":
            return dict.fromkeys(ends, 0)
        return dict(ends) if wanted == "latest" else {p: int(json.loads(wanted).get(p, 0)) for p in ends}

    def spans(self, start: dict[str, int], end: dict[str, int], each: bool) -> list[Span]:
        """Tasks for a range of offsets: one for each segment or one for each partition."""
        found = []
        for p, parts in self.files().items():
            first, last = start.get(str(p), 0), end.get(str(p), 0)
            nexts = [base for base, _ in parts[1:]] + [last]
            reached = [file for (base, file), after in zip(parts, nexts) if base < last and after > first]
            if reached and first < last:
                found += [Span([file], first, last) for file in reached] if each else [Span(reached, first, last)]
        return found

    def rows(self, span: Span) -> Iterator[pa.RecordBatch]:
        for file in span.files:
            with self.fs.open_input_file(file) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=4096, columns=_NAMES):
                    offset = batch.column("offset")
                    kept = batch.filter(pc.and_(pc.greater_equal(offset, span.start), pc.less(offset, span.end)))
                    if len(kept):
                        yield kept.select(_NAMES)


class BoundedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Span]:
        log = Segments(self.options["path"])
        ends = log.ends()
        start = log.place(self.options.get("startingoffsets", "earliest"), ends)
        return log.spans(start, log.place(self.options.get("endingoffsets", "latest"), ends), each=True) or [Span([], 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Segments(self.options["path"]).rows(partition)


class LogStreamReader(DataSourceStreamReader):
    """Hands out offsets a trigger at a time.

    Spark does not tell a restarted reader where the checkpoint stands before it asks for the next end. The end of the batch
    planned last is therefore kept beside the log under the reader's ``group``, one for each checkpoint. A batch is
    planned once its offsets are in the checkpoint, and again after a restart if it was not finished, so that end is where
    the next batch starts.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.limit = options, int(options.get("maxrowspertrigger", 0))
        self.least, self.delay = int(options.get("minrowspertrigger", 0)), float(options.get("maxtriggerdelay", 0))
        self.planned = time.monotonic()
        self.log, self.start, self.upto = Segments(options["path"]), None, None
        if self.limit and not options.get("group"):
            raise ValueError("maxRowsPerTrigger needs a group, one for each checkpoint")
        if self.least > self.limit:
            raise ValueError("minRowsPerTrigger needs a maxRowsPerTrigger that is no less")
        self.kept = f"{self.log.root}/_positions/{options.get('group')}.json"

    def _begin(self) -> None:
        if self.start is not None:
            return
        if self.limit and self.log.fs.get_file_info(self.kept).type == pafs.FileType.File:
            with self.log.fs.open_input_stream(self.kept) as source:
                position = json.loads(source.read())
            self.start, self.upto = position["start"], position["upto"]
        else:
            self.start = self.upto = self.log.place(self.options.get("startingoffsets", "latest"), self.log.ends())
            self._keep()

    def _keep(self) -> None:
        if self.limit:
            self.log.fs.create_dir(f"{self.log.root}/_positions")
            with self.log.fs.open_output_stream(self.kept) as out:
                out.write(json.dumps({"start": self.start, "upto": self.upto}).encode())

    def initialOffset(self) -> dict:
        self._begin()
        return self.start

    def latestOffset(self) -> dict:
        self._begin()
        if not self.limit:
            return self.log.ends()
        files = self.log.files()
        ends = self.log.ends(files)
        behind, left, reached = [p for p in ends if self.upto.get(p, 0) < ends[p]], self.limit, {**ends, **self.upto}
        for at, p in enumerate(behind):
            reached[p], taken = self._advance(files[int(p)], self.upto.get(p, 0), max(1, left // (len(behind) - at)))
            left -= taken
        waiting = self.limit - left < self.least and time.monotonic() - self.planned < self.delay
        return self.upto if waiting else reached

    def _advance(self, parts: list[tuple[int, str]], start: int, rows: int) -> tuple[int, int]:
        """The offset ``rows`` rows after ``start``, and how many rows there were."""
        taken, end = 0, start
        for (base, file), after in zip(parts, [b for b, _ in parts[1:]] + [None]):
            if after is not None and after <= start:
                continue
            offsets = self.log.offsets(file)
            offsets = offsets.filter(pc.greater_equal(offsets, start))
            if len(offsets):
                last = min(len(offsets), rows - taken)
                end, taken = offsets[last - 1].as_py() + 1, taken + last
            if taken >= rows:
                break
        return end, taken

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self._begin()
        self.upto, self.planned = end, time.monotonic()
        self._keep()
        return self.log.spans(start, end, each=False)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return Segments(self.options["path"]).rows(partition)


class SegmentWriter(DataSourceArrowWriter):
    """Writes segments; rows reach a task in order of partition and offset, or without offsets, to be numbered here."""

    def __init__(self, options: dict[str, str]):
        self.options, self.ends = options, Segments(options["path"]).ends()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        log, done, at, out = Segments(self.options["path"]), Written(), None, None
        held, size, count = [], 0, 0

        def group() -> None:
            """Write what is held as a row group of the open segment."""
            nonlocal out, held, size
            if not held:
                return
            if out is None:
                folder = f"{log.root}/partition={at}"
                log.fs.create_dir(folder)
                draft = f"{folder}/_{uuid.uuid4().hex}"
                done.moves.append((draft, f"{folder}/{held[0].column('offset')[0].as_py():020d}.parquet"))
                out = pq.ParquetWriter(draft, held[0].schema, filesystem=log.fs)
            out.write_table(pa.Table.from_batches(held))
            held, size = [], 0

        def close() -> None:
            nonlocal out, count
            group()
            if out is not None:
                out.close()
            out, count = None, 0

        for batch in iterator:
            for p in pc.unique(batch.column("partition")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("partition"), p))
                if p != at:
                    close()
                    at = p
                if rows.column("offset").null_count:
                    first = self.ends.get(str(p), 0)
                    self.ends[str(p)] = first + len(rows)
                    index = rows.schema.get_field_index("offset")
                    rows = rows.set_column(index, "offset", pa.array(range(first, first + len(rows)), pa.int64()))
                held.append(rows)
                size += rows.nbytes
                count += len(rows)
                if size >= GROUP_BYTES:
                    group()
                if count >= SEGMENT_ROWS:
                    close()
        close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        log = Segments(self.options["path"])
        for message in messages:
            for draft, path in message.moves if message else []:
                log.fs.move(draft, path)

    def abort(self, messages: list[Written | None]) -> None:
        log = Segments(self.options["path"])
        for message in messages:
            for draft, _ in message.moves if message else []:
                log.fs.delete_file(draft)


class EventLog(DataSource):
    """``spark.read.format("event_log").option("path", folder)``; options as below, names in any case.

    startingOffsets, endingOffsets: ``earliest``, ``latest`` or JSON (a stream starts at latest, a batch at earliest);
    maxRowsPerTrigger and group: bound a stream's micro-batches (under ``availableNow`` the limit bounds the whole run);
    minRowsPerTrigger and maxTriggerDelay (seconds): fewer rows wait until so long after the last batch.
    """

    def __init__(self, options: dict[str, str]):
        # no look-up in the options object below is case-sensitive
        self.options = {k.lower(): v for k, v in options.items()}

    @classmethod
    def name(cls) -> str:
        return EVENT_LOG

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> BoundedReader:
        return BoundedReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; the classes travel to workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(EventLog)


def append(rows: DataFrame, path: str) -> None:
    """Add rows of the log's columns, with their partitions and offsets, as segments.

    A partition's rows are spread over tasks by ranges of offsets, so a hot partition is written by several.
    """
    register(rows.sparkSession)
    order = ["partition", "offset"]
    rows.select(*_NAMES).repartitionByRange(*order).sortWithinPartitions(*order).write.format(EVENT_LOG).mode("append").save(path)


def publish(messages: DataFrame, path: str, partitions: int, order: tuple[str, ...] = ("timestamp",), topic: str = "telemetry.events") -> None:
    """Add keyed messages: the key's hash names the partition, each is one task and numbers its rows in the given order.

    One publisher at a time. A null key goes to partition 0.
    """
    register(messages.sparkSession)
    headers = F.col("headers") if "headers" in messages.columns else F.array().cast("array<struct<key string, value binary>>")
    placed = messages.withColumns({
        "topic": F.lit(topic), "partition": F.coalesce(log_partition("key", partitions), F.lit(0)),
        "offset": F.lit(None).cast("long"), "headers": headers})
    placed.repartitionById(partitions, "partition").sortWithinPartitions("partition", *order, "key", "value").select(*_NAMES).write.format(
        EVENT_LOG).mode("append").save(path)
