"""Additive measures, safe ratios and the tenant shard id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 32
COUNTS = ("events_count", "ok_count", "warn_count", "error_count")
# FNV-1a, 32 bit (fixed values)
FNV_OFFSET, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295


def measures(time_name: str = "last_event_at") -> list[Column]:
    """Six-measure accumulator over event rows."""
    return [
        F.count(F.lit(1)).alias("events_count"),
        F.count_if(F.col("status") == "ok").alias("ok_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"),
        F.count_if(~F.coalesce(F.col("status").isin("ok", "warn"), F.lit(False))).alias("error_count"),
        F.sum("value").alias("value_sum"),
        F.max("timestamp").alias(time_name),
    ]


def merged_measures(time_name: str = "last_event_at", out: str | None = None) -> list[Column]:
    """The same accumulator over partial aggregates."""
    return [
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("value_sum").alias("value_sum"),
        F.max(time_name).alias(out or time_name),
    ]


def displayed(value: Column | str, digits: int = 9) -> Column:
    """A double to so many significant digits.

    Sums of doubles differ in their last digits with the order of addition; this is for reports
    and comparisons, never for what is stored or merged.
    """
    return F.format_string(f"%.{digits - 1}e", F.col(value) if isinstance(value, str) else value).cast("double")


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, or 0 where there is nothing to divide by."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def per_second(amount: Column | str, seconds: Column | str, digits: int = 2) -> Column:
    """Rate over at least one second, rounded half to even."""
    amt = F.col(amount) if isinstance(amount, str) else amount
    sec = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.bround(amt / F.greatest(sec, F.lit(1.0)), digits)


def shard_id(tenant: str = "tenant_id", source: str = "source_id", shards: int = SHARDS) -> Column:
    """FNV-1a over ``tenant 0x00 source``, modulo the shard count.

    The UTF-8 bytes are read as Latin-1 so every byte is one character.
    """
    return F.expr(
        f"CAST(aggregate(split(decode(encode(concat({tenant}, chr(0), {source}), 'UTF-8'), 'ISO-8859-1'), ''),"
        f" {FNV_OFFSET}L, (h, c) -> ((h ^ ascii(c)) * {FNV_PRIME}L) & {FNV_MASK}L) % {shards} AS INT)"
    )


def fnv1a(data: Column | str) -> Column:
    """FNV-1a, 32 bit, of a text's UTF-8 bytes or of binary data, as a number from 0 to 2**32 - 1."""
    col = F.col(data) if isinstance(data, str) else data
    characters = F.split(F.decode(col.cast("binary"), "ISO-8859-1"), "")

    def step(h: Column, c: Column) -> Column:
        return (h.bitwiseXOR(F.ascii(c).cast("bigint")) * FNV_PRIME).bitwiseAND(F.lit(FNV_MASK))

    folded = F.aggregate(characters, F.lit(FNV_OFFSET).cast("bigint"), step)
    return F.when(F.octet_length(col) == 0, F.lit(FNV_OFFSET).cast("bigint")).otherwise(folded)


def log_partition(key: Column | str, partitions: int) -> Column:
    """The partition to which the log's client sends a key: its hash as a signed number, modulo, without the sign."""
    h = fnv1a(key)
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.abs(signed % F.lit(partitions)).cast("int")
