"""Load-run analytics over a long table ``(run_id, sample_ts, metric, value)``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.measures import per_second
from tidemark.functions.timeparts import seconds_between

# Which end-minus-start delta feeds which rate (fixed names)
RATES = {
    "accepted_total": "accepted", "processed_total": "processed", "duplicate_total": "duplicate",
    "rejected_total": "rejected", "sent_total": "producer_sent", "failed_total": "producer_failed",
}
RATED = ("accepted", "processed", "rejected", "producer_sent", "producer_failed")


def run_rates(samples: DataFrame, metrics: Mapping[str, str] = RATES) -> DataFrame:
    """Plain end-minus-start deltas and per-second rates of each run.

    One pass, one shuffle: per (run) the first and last value of every metric.
    """
    def is_metric(m: str) -> Column:
        return F.col("metric") == m

    cols: list[Column] = []
    for metric, name in metrics.items():
        at = F.when(is_metric(metric), F.col("sample_ts"))
        cols.append(
            F.coalesce(F.max_by("value", at) - F.min_by("value", at), F.lit(0.0)).cast("bigint").alias(f"{name}_total_delta")
        )
    totals = samples.groupBy("run_id").agg(
        F.bround(seconds_between(F.max("sample_ts"), F.min("sample_ts")), 2).alias("measured_duration_seconds"), *cols
    )
    names = set(metrics.values())
    rated = [
        per_second(f"{n}_total_delta", "measured_duration_seconds").alias(f"{n}_eps") for n in RATED if n in names
    ]
    result = totals.select("*", *rated)
    if {"accepted", "producer_sent"} <= names:
        result = result.withColumn(
            "offered_to_accepted_ratio", offered_ratio(F.col("accepted_total_delta"), F.col("producer_sent_total_delta"))
        )
    return result


def offered_ratio(accepted: Column, sent: Column) -> Column:
    return F.when(sent > 0, F.bround(accepted / sent, 4)).otherwise(F.lit(0.0))


def run_peaks(samples: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Highest value of each metric in a run, never below 0: ``{metric: output name}``."""
    return samples.groupBy("run_id").agg(*[
        F.greatest(F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)), F.lit(0.0)).alias(name)
        for m, name in metrics.items()
    ])


def drain_seconds(lag: DataFrame, stops: DataFrame, timeout_seconds: float = 60.0) -> DataFrame:
    """Seconds from load stop to the first sample at or below the pre-run lag.

    ``lag``: ``(run_id, sample_ts, value)``; ``stops``: one row per run
    ``(run_id, stopped_at, target_lag)``. A run that never drains reports the timeout.
    """
    elapsed = seconds_between(F.col("sample_ts"), "stopped_at")
    hit = F.when(
        (F.col("sample_ts") >= F.col("stopped_at")) & (elapsed <= timeout_seconds) & (F.col("value") <= F.col("target_lag")),
        elapsed,
    )
    found = lag.join(stops, "run_id").groupBy("run_id").agg(F.min(hit).alias("__s"))
    return stops.select("run_id").join(found, "run_id", "left").select(
        "run_id", F.bround(F.coalesce("__s", F.lit(timeout_seconds)), 2).alias("post_load_drain_seconds")
    )


def recovery_by_lag(lag: DataFrame, markers: DataFrame, limit: float = 100.0) -> DataFrame:
    """First sample after the marker with lag at most ``limit``: ``markers(run_id, marked_at)``."""
    hit = F.when((F.col("sample_ts") > F.col("marked_at")) & (F.col("value") <= limit), F.col("sample_ts"))
    return _recovered(lag.join(markers, "run_id").groupBy("run_id", "marked_at").agg(F.min(hit).alias("recovered_at")))


def recovery_by_counter(counter: DataFrame, markers: DataFrame) -> DataFrame:
    """First sample after the marker above the value the counter had at the marker.

    Without a sample up to the marker the final value is the baseline.
    """
    joined = counter.join(markers, "run_id")
    before = F.when(F.col("sample_ts") <= F.col("marked_at"), F.col("sample_ts"))
    baseline = joined.groupBy("run_id").agg(
        F.coalesce(F.max_by("value", before), F.max_by("value", "sample_ts")).alias("baseline")
    )
    hit = F.when(
        (F.col("sample_ts") > F.col("marked_at")) & (F.col("value") > F.col("baseline")), F.col("sample_ts")
    )
    return _recovered(
        joined.join(baseline, "run_id").groupBy("run_id", "marked_at").agg(F.min(hit).alias("recovered_at"))
    )


def _recovered(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "recovered_at", F.col("recovered_at").isNotNull().alias("recovered_within_window"),
        F.bround(seconds_between(F.col("recovered_at"), "marked_at"), 2).alias("recovery_seconds"),
    )
