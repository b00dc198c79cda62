"""The event log: streaming and bounded reads, and rows to publish."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import encode_event, event_struct, partition_key
from tidemark.schemas import LOG_MESSAGE
from tidemark.sources.log import EVENT_LOG, publish, register

_KAFKA = {"startingOffsets": "latest", "includeHeaders": "true", "failOnDataLoss": "true"}


def _shaped(raw: DataFrame) -> DataFrame:
    """Kafka's columns, with the message time named ``log_time``."""
    return raw.select(
        "key", "value", "topic", "partition", "offset", F.col("timestamp").alias("log_time"), "headers"
    )


def read_events_stream(spark: SparkSession, fmt: str, options: Mapping[str, str], path: str | None = None) -> DataFrame:
    """Unbounded log. ``kafka`` starts at the latest offset; file formats carry the same columns.

    Stored segments (``event_log``) start at the latest offset too. Bound a micro-batch with ``maxOffsetsPerTrigger``
    (Kafka), ``maxRowsPerTrigger`` (segments) or ``maxFilesPerTrigger``.
    """
    if fmt == EVENT_LOG:
        register(spark)
        return _shaped(spark.readStream.format(fmt).options(**options).load(path))
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return _shaped(reader.options(**{**_KAFKA, **options}).load())
    return _shaped(reader.schema(LOG_MESSAGE).options(**options).load(path))


def read_events_batch(spark: SparkSession, fmt: str, options: Mapping[str, str] = {}, path: str | None = None) -> DataFrame:
    """Bounded read of the same log."""
    if fmt == EVENT_LOG:
        register(spark)
        return _shaped(spark.read.format(fmt).options(**options).load(path))
    if fmt == "kafka":
        bounded = {**_KAFKA, "startingOffsets": "earliest", "endingOffsets": "latest", **options}
        return _shaped(spark.read.format(fmt).options(**bounded).load())
    return _shaped(spark.read.format(fmt).schema(LOG_MESSAGE).options(**options).load(path))


def to_log_rows(events: DataFrame, event: Column | None = None) -> DataFrame:
    """Messages to publish: key ``tenant:source``, JSON value, message time = event time."""
    whole = event if event is not None else event_struct()
    e = events.select("*", whole.alias("__event"))
    return e.select(
        partition_key("__event.tenant_id", "__event.source_id").cast("binary").alias("key"),
        encode_event(F.col("__event")).cast("binary").alias("value"),
        F.col("__event.timestamp").alias("timestamp"),
    )


def write_log(rows: DataFrame, fmt: str, options: Mapping[str, str] = {}, path: str | None = None) -> None:
    """Publish messages; Kafka partitions by key on its own, segments by the same hash over ``partitions``."""
    if fmt == EVENT_LOG:
        return publish(rows, path, int(options.get("partitions", 12)))
    if fmt == "kafka":
        # Kafka has no timestamp column on write; the event time stays inside the value
        rows.select("key", "value", *[c for c in ("headers",) if c in rows.columns]).write.format("kafka").options(
            **{"includeHeaders": "true", **options}
        ).save()
    else:
        rows.write.format(fmt).mode("append").options(**options).save(path)
