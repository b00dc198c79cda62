"""Rejected requests: what is stored, and how often each reason occurred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null, exact_json

NOT_STORED = ("backpressure",)
NOT_COUNTED = ("forbidden",)
BAD_PAYLOAD = '{"raw":"payload_not_valid_json"}'


def to_rejections(
    rejected: DataFrame, payload: Column, created_at: Column, row_id: Column,
) -> DataFrame:
    """Stored rows: empty ids become NULL, a payload that is not JSON becomes a marker."""
    return rejected.where(F.col("reason").isNotNull() & ~F.col("reason").isin(*NOT_STORED, *NOT_COUNTED)).select(
        row_id.cast("string").alias("id"),
        "reason",
        blank_to_null(F.trim("tenant_id")).alias("tenant_id"),
        blank_to_null(F.trim("source_id")).alias("source_id"),
        F.when(exact_json(payload).isNotNull(), payload).otherwise(F.lit(BAD_PAYLOAD)).alias("payload"),
        created_at.alias("created_at"),
    )


def rejection_counts(rejected: DataFrame) -> DataFrame:
    """Counter by reason; every rejection counts, stored or not."""
    return (
        rejected.where(F.col("reason").isNotNull() & ~F.col("reason").isin(*NOT_COUNTED))
        .groupBy("reason").agg(F.count(F.lit(1)).alias("total"))
    )
