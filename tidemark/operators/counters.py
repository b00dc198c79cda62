"""Counters and histograms over metric samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import previous_value

# A day of samples per scan block.
SAMPLE_BLOCK_US = 86_400_000_000


def increments(
    samples: DataFrame, keys: Sequence[str], ts: str = "sample_ts", value: str = "value",
    block: int = SAMPLE_BLOCK_US,
) -> DataFrame:
    """Add ``increment``: growth since the previous sample; a drop is a restart from 0."""
    df = previous_value(samples, keys, ts, value, "__prev", block)
    grown = (
        F.when(F.col("__prev").isNull(), F.lit(0)).when(F.col(value) >= F.col("__prev"), F.col(value) - F.col("__prev"))
        .otherwise(F.col(value))
    )
    return df.withColumn("increment", grown).drop("__prev")


def counter_increase(
    samples: DataFrame, keys: Sequence[str], ts: str = "sample_ts", value: str = "value",
    block: int = SAMPLE_BLOCK_US,
) -> DataFrame:
    """Reset-aware increase of each series over all its samples."""
    return increments(samples, keys, ts, value, block).groupBy(*keys).agg(
        F.round(F.sum("increment"), 0).cast("bigint").alias("increase")
    )


def accounting_gap(increases: DataFrame, run: str = "run_id") -> DataFrame:
    """Archived minus accepted minus failed publishes, from per-metric increases."""
    def metric(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("increase"))), F.lit(0)).cast("bigint")

    return increases.groupBy(run).agg(
        metric("archived_total").alias("archived_total_delta"),
        metric("accepted_total").alias("accepted_total_delta"),
        metric("publish_failed_total").alias("publish_failed_total_delta"),
        (metric("archived_total") - metric("accepted_total")).alias("archived_not_accepted_delta"),
        (metric("archived_total") - metric("accepted_total") - metric("publish_failed_total"))
        .alias("archive_accounting_gap"),
    )


def histogram_quantile(
    buckets: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.50, 0.95, 0.99),
    scale: float = 1000.0, digits: int = 2,
) -> DataFrame:
    """Quantiles from cumulative bucket growth: rows ``(keys, le, amount)``.

    ``le`` is the upper bound (infinity for the last). Inside the bucket that holds the
    rank the value is interpolated; a rank in the last bucket yields the highest finite
    bound. Bounds per key are few, so the window is over a handful of rows.
    """
    keys = list(keys)
    merged = buckets.groupBy(*keys, "le").agg(F.sum("amount").alias("cum"))
    order = Window.partitionBy(*keys).orderBy("le")
    spans = merged.select(
        *keys, "le", "cum",
        F.lag("le", 1, 0.0).over(order).alias("lo"),
        F.lag("cum", 1, 0.0).over(order).alias("before"),
        F.max("cum").over(Window.partitionBy(*keys)).alias("total"),
    )
    outs = []
    for q in quantiles:
        rank = F.lit(q) * F.col("total")
        holds = (F.col("cum") >= rank) & (F.col("before") < rank)
        inside = F.col("lo") + (F.col("le") - F.col("lo")) * F.try_divide(
            rank - F.col("before"), F.col("cum") - F.col("before")
        )
        point = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(inside)
        outs.append(F.bround(F.min(F.when(holds, point)) * scale, digits).alias(f"p{q * 100:g}_ms"))
    return spans.groupBy(*keys).agg(*outs)


def bucket_growth(
    samples: DataFrame, keys: Sequence[str], as_of: Column, seconds: float = 120.0,
    series: Sequence[str] = (), ts: str = "sample_ts", value: str = "value",
) -> DataFrame:
    """Reset-aware growth of cumulative buckets in the last ``seconds``: ``(keys, le, amount)``."""
    at = F.unix_micros(ts)
    recent = samples.where((at > F.unix_micros(as_of) - round(seconds * 1_000_000)) & (at <= F.unix_micros(as_of)))
    grown = increments(recent, [*keys, *series, "le"], ts, value)
    return grown.groupBy(*keys, "le").agg(F.sum("increment").cast("double").alias("amount"))
