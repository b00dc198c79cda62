"""Dead-letter records for log rows that could not be decoded or validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import base64_text, is_blank, null_to_empty, trim_space
from tidemark.schemas import DEAD_LETTER

DEFAULT_REASON = "invalid_message"
REASON_HEADER = "dead-letter-reason"


def _trimmed(c: str) -> Column:
    return trim_space(null_to_empty(c))


def to_dead_letters(failed: DataFrame, consumer_group: str, failed_at: Column | None = None) -> DataFrame:
    """Build records from classified log rows (``reason`` set, Kafka-shaped columns kept)."""
    headers = F.transform(
        F.coalesce("headers", F.expr("array()").cast(failed.schema["headers"].dataType)),
        lambda h: F.struct(h["key"].alias("key"), base64_text(h["value"]).alias("value_base64")),
    )
    return failed.select(
        (failed_at if failed_at is not None else F.current_timestamp()).alias("failed_at"),
        F.when(is_blank("reason"), DEFAULT_REASON).otherwise(trim_space("reason")).alias("reason"),
        null_to_empty("error").alias("error"),
        F.col("topic").alias("source_topic"),
        F.col("partition").alias("source_partition"),
        F.col("offset").alias("source_offset"),
        null_to_empty(F.col("key").cast("string")).alias("source_key"),
        F.lit(consumer_group.strip()).alias("consumer_group"),
        _trimmed("event.event_id").alias("event_id"),
        _trimmed("event.tenant_id").alias("tenant_id"),
        _trimmed("event.source_id").alias("source_id"),
        base64_text(F.col("value").cast("binary")).alias("payload_base64"),
        headers.alias("headers"),
    )


def encode_dead_letter(record: Column) -> Column:
    """JSON text; empty optional fields are left out."""
    required = {"failed_at", "reason", "error", "source_topic", "source_partition", "source_offset", "payload_base64"}
    fields = []
    for f in DEAD_LETTER.fields:
        value = record.getField(f.name)
        if f.name == "headers":
            value = F.when(F.size(value) > 0, value)
        elif f.name not in required:
            value = F.when(value != "", value)
        fields.append(value.alias(f.name))
    return F.to_json(F.struct(*fields), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def dead_letter_log(records: DataFrame) -> DataFrame:
    """Rows for the dead-letter log: original key, JSON value, reason header."""
    whole = F.struct(*[F.col(c) for c in records.columns])
    return records.select(
        F.col("source_key").cast("binary").alias("key"),
        encode_dead_letter(whole).cast("binary").alias("value"),
        F.array(F.struct(F.lit(REASON_HEADER).alias("key"), F.col("reason").cast("binary").alias("value"))).alias("headers"),
        F.col("failed_at").alias("timestamp"),
    )
