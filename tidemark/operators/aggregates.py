"""Additive hot aggregates.

All three views nest in one finer grain, (tenant, source, 10 s bucket). The heavy pass
over events happens once; every view is a merge of that much smaller table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import SHARDS, measures, merged_measures, shard_id
from tidemark.functions.timeparts import bucket_start

BUCKET_SECONDS = 10
WINDOW_SECONDS = (60, 300)
GRAIN_KEYS = ("tenant_id", "source_id", "bucket_start")


def base_grain(recorded: DataFrame, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Measures per (tenant, source, bucket); hot keys collapse before the shuffle."""
    return recorded.groupBy(
        "tenant_id", "source_id", bucket_start("timestamp", seconds).alias("bucket_start")
    ).agg(*measures())


def tenant_shards(grain: DataFrame, shards: int = SHARDS) -> DataFrame:
    """10 s tenant buckets, split by a stable hash of the source."""
    return (
        grain.withColumn("shard_id", shard_id(shards=shards))
        .groupBy("bucket_start", "tenant_id", "shard_id")
        .agg(*merged_measures())
    )


def source_metrics(grain: DataFrame) -> DataFrame:
    """Cumulative count and last event per source."""
    return grain.groupBy("tenant_id", "source_id").agg(
        F.sum("events_count").alias("events_count"), F.max("last_event_at").alias("last_event_at")
    )


def event_windows(grain: DataFrame, sizes: Sequence[int] = WINDOW_SECONDS) -> DataFrame:
    """Tumbling event-time windows of several sizes per source, in one shuffle.

    Grain rows (not events) fan out to one row per size just before the merge.
    """
    for size in sizes:
        if size % BUCKET_SECONDS:
            raise ValueError(f"window size must be a multiple of {BUCKET_SECONDS}s")
    starts = F.array(*[
        F.struct(F.lit(s).alias("size"), bucket_start("bucket_start", s).alias("start")) for s in sizes
    ])
    return (
        grain.withColumn("w", F.explode(starts))
        .groupBy(
            F.col("w.size").alias("window_size_seconds"), F.col("w.start").alias("window_start"),
            "tenant_id", "source_id",
        )
        .agg(*merged_measures("last_event_at", "max_event_at"))
    )


def tenant_rollup(shards: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """(bucket, tenant) totals; unsharded legacy rows add to the sharded ones."""
    columns = ["bucket_start", "tenant_id", "events_count", "ok_count", "warn_count",
               "error_count", "value_sum", "last_event_at"]
    rows = shards.select(*columns)
    if legacy is not None:
        rows = rows.unionByName(legacy.select(*columns))
    return rows.groupBy("bucket_start", "tenant_id").agg(*merged_measures())


def rollup(deltas: DataFrame, keys: Sequence[str], sums: Sequence[str], maxima: Sequence[str]) -> DataFrame:
    """Merge additive deltas: counts and sums add up, times take the greatest."""
    return deltas.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])


def count_by(df: DataFrame, label: str = "reason") -> DataFrame:
    """Labelled counter."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("total"))


# Upper bounds of the batch-size histogram (fixed values)
SIZE_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def histogram(df: DataFrame, value: str, bounds: Sequence[float] = SIZE_BOUNDS) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, and all rows as ``+Inf``."""
    names = [f"{b:g}" for b in bounds] + ["+Inf"]
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    wide = df.agg(*[c.alias(f"b{i}") for i, c in enumerate(counts)])
    pairs = ", ".join(f"'{n}', b{i}" for i, n in enumerate(names))
    return wide.select(F.expr(f"stack({len(names)}, {pairs}) AS (le, bucket_count)"))
