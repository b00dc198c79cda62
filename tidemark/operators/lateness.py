"""Late or on time, against the highest event time seen so far in the log partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeparts import minus_seconds
from tidemark.operators.scans import running_max

LOG_KEYS = ("topic", "partition")
ALLOWED_LATENESS_SECONDS = 120.0
OFFSETS_PER_BLOCK = 1_000_000


def mark_late(
    log: DataFrame,
    lateness_seconds: float = ALLOWED_LATENESS_SECONDS,
    marks: DataFrame | None = None,
    block: int = OFFSETS_PER_BLOCK,
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``max_event_time`` and ``late``.

    The mark counts every valid row, duplicates and the current row included; a row is
    late when it is strictly more than the allowance behind it. ``marks`` carries
    ``(topic, partition, max_event_time)`` over from earlier batches; ``ties`` orders rows
    whose offsets are equal, which a real log never has.
    """
    marked = running_max(log, LOG_KEYS, "offset", F.col("timestamp"), "max_event_time", block, ties)
    if marks is not None:
        earlier = marks.select(*LOG_KEYS, F.col("max_event_time").alias("__mark"))
        marked = (
            marked.join(earlier, list(LOG_KEYS), "left")
            .withColumn("max_event_time", F.greatest("max_event_time", "__mark"))
            .drop("__mark")
        )
    return marked.withColumn(
        "late", F.col("timestamp") < minus_seconds(F.col("max_event_time"), lateness_seconds)
    )


def partition_marks(log: DataFrame) -> DataFrame:
    """Highest event time per log partition, to be carried into the next batch."""
    return log.groupBy(*LOG_KEYS).agg(F.max("timestamp").alias("max_event_time"))
