"""What happened to each log row: recorded, duplicate or late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lateness import LOG_KEYS


def partition_progress(log: DataFrame, winners: DataFrame, end_offsets: DataFrame | None = None) -> DataFrame:
    """Per log partition: totals by disposition, last offset, last seen, lag.

    Duplicates are arrivals minus claims, so repeated rows are counted where they are
    read and never shuffled. Lag is log end offset minus last processed offset.
    """
    arrivals = log.groupBy(*LOG_KEYS).agg(
        F.count(F.lit(1)).alias("arrived"),
        F.max("offset").alias("last_offset"),
        F.max("log_time").alias("last_seen_at"),
    )
    kept = winners.groupBy(*LOG_KEYS).agg(
        F.count_if(~F.col("late")).alias("processed_total"),
        F.count_if("late").alias("late_event_total"),
    )
    zero = F.lit(0).cast("bigint")
    progress = arrivals.join(kept, list(LOG_KEYS), "left").select(
        *LOG_KEYS,
        F.coalesce("processed_total", zero).alias("processed_total"),
        (F.col("arrived") - F.coalesce("processed_total", zero) - F.coalesce("late_event_total", zero))
        .alias("duplicate_total"),
        F.coalesce("late_event_total", zero).alias("late_event_total"),
        "last_offset",
        "last_seen_at",
    )
    return progress if end_offsets is None else with_lag(progress, end_offsets)


def with_lag(progress: DataFrame, end_offsets: DataFrame) -> DataFrame:
    """Add lag and messages in flight, from the log's ends (topic, partition, end_offset)."""
    zero = F.lit(0).cast("bigint")
    ends = end_offsets.select(*LOG_KEYS, F.col("end_offset").alias("__end"))
    lag = F.greatest(F.coalesce(F.col("__end") - F.col("last_offset"), zero), zero)
    return (
        progress.join(ends, list(LOG_KEYS), "left")
        .withColumn("lag", lag)
        # everything behind the end offset but not yet processed is still in flight
        .withColumn("inflight_messages", F.col("lag"))
        .drop("__end")
    )


def disposition_counts(progress: DataFrame) -> DataFrame:
    """Totals over all partitions, one row per disposition."""
    totals = progress.agg(
        F.sum("processed_total").alias("recorded"),
        F.sum("duplicate_total").alias("duplicate"),
        F.sum("late_event_total").alias("late"),
    )
    return totals.select(
        F.expr("stack(3, 'recorded', recorded, 'duplicate', duplicate, 'late', late)"
               " AS (disposition, row_count)")
    ).withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
