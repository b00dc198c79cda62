"""Alert rules over metric samples: a condition must hold for a while before it fires."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.counters import SAMPLE_BLOCK_US, increments
from tidemark.operators.scans import running_max, trailing_sum

_NEVER = "1970-01-01 00:00:00"


def sustained(
    samples: DataFrame, condition: Column, for_seconds: float, keys: Sequence[str] = (), ts: str = "sample_ts",
    block: int = SAMPLE_BLOCK_US,
) -> DataFrame:
    """Periods in which ``condition`` held at every sample for at least ``for_seconds``.

    A period is named by the last sample before it where the condition failed, found
    with a blocked running max, so long series are split over tasks. Gives
    ``started_at``, ``fired_at`` (first sample at which the alert is active),
    ``ended_at`` (last sample of the period).
    """
    keys = list(keys)
    flagged = samples.withColumn("__on", F.coalesce(condition, F.lit(False)))
    named = running_max(flagged, keys, ts, F.when(~F.col("__on"), F.col(ts)), "__off", block)
    active = named.where("__on").select(
        *keys, F.col(ts).alias("__ts"), F.coalesce("__off", F.lit(_NEVER).cast("timestamp")).alias("__off")
    )
    due = round(for_seconds * 1_000_000)
    periods = (
        active.groupBy(*keys, "__off").agg(F.min("__ts").alias("started_at"), F.max("__ts").alias("ended_at"))
        .where(F.unix_micros("ended_at") - F.unix_micros("started_at") >= due)
    )
    fired = F.min(F.when(F.unix_micros("__ts") - F.unix_micros("started_at") >= due, F.col("__ts")))
    return (
        active.join(periods, [*keys, "__off"])
        .groupBy(*keys, "started_at", "ended_at").agg(fired.alias("fired_at"))
        .select(*keys, "started_at", "fired_at", "ended_at")
    )


def lag_alert(samples: DataFrame, limit: float = 500, for_seconds: float = 120) -> DataFrame:
    """Summed consumer lag above the limit for two minutes: rows ``(sample_ts, value)``."""
    total = samples.groupBy("sample_ts").agg(F.sum("value").alias("value"))
    return sustained(total, F.col("value") > limit, for_seconds)


def rate_alert(
    samples: DataFrame, series: Sequence[str], limit: float = 5, range_seconds: float = 300, for_seconds: float = 60,
) -> DataFrame:
    """Summed counter rate above the limit: growth in the trailing range over its length."""
    return sustained(trailing_rate(samples, series, range_seconds), F.col("rate") > limit, for_seconds)


def trailing_rate(samples: DataFrame, series: Sequence[str], range_seconds: float = 300) -> DataFrame:
    growth = increments(samples, series).groupBy("sample_ts").agg(F.sum("increment").alias("__g"))
    summed = trailing_sum(growth, [], "sample_ts", "__g", range_seconds, "__sum")
    return summed.select("sample_ts", (F.col("__sum") / range_seconds).alias("rate"))


def liveness_alerts(up: DataFrame, for_seconds: float = 30) -> DataFrame:
    """All replicas down, and any replica down: rows ``(sample_ts, instance_id, value)``, value 1 = up."""
    ticks = up.groupBy("sample_ts").agg(F.sum("value").alias("live"), F.count_if(F.col("value") == 0).alias("down"))
    everyone = sustained(ticks, F.col("live") == 0, for_seconds).withColumn("alert", F.lit("AllStreamProcessorsDown"))
    someone = sustained(ticks, F.col("down") > 0, for_seconds).withColumn("alert", F.lit("StreamProcessorReplicaDown"))
    return everyone.unionByName(someone)
