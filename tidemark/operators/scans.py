"""Ordered scans (running max, previous value) that never need a whole key in one task.

A plain window partitioned by key sorts all rows of a key in one task. Here every key is
cut into blocks of its order column. Pass 1 folds each block to one row (map-side
combined); a window over those few rows carries the result of all earlier blocks. Pass 2
runs the same window inside the blocks and adds the carried part. With dense log offsets
a block holds at most ``block`` rows, so no task grows with the data.

The carried table is joined without a hint: Spark broadcasts it only when its measured
size is below the broadcast threshold, else the join and the window share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK, _CARRIED = "__block", "__carried"


def _with_block(df: DataFrame, order: Column, block: int) -> DataFrame:
    return df.withColumn(_BLOCK, order - F.pmod(order, F.lit(block)))


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number: microseconds for timestamps."""
    kind = df.schema[order].dataType.typeName()
    return F.unix_micros(order) if kind == "timestamp" else F.col(order)


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int,
    ties: Sequence[str] = (),
) -> DataFrame:
    """``max(value)`` over all rows of the key up to and including the current one."""
    keys = list(keys)
    blocked = _with_block(df, order_number(df, order), block)
    tops = blocked.groupBy(*keys, _BLOCK).agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, _BLOCK, F.max("__top").over(earlier).alias(_CARRIED))
    inside = (
        Window.partitionBy(*keys, _BLOCK).orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.join(carried, [*keys, _BLOCK])
        .withColumn(out, F.greatest(F.max(value).over(inside), F.col(_CARRIED)))
        .drop(_BLOCK, _CARRIED)
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int,
) -> DataFrame:
    """``lag(value)`` over the key; the first row of a block looks into the block before."""
    keys = list(keys)
    blocked = _with_block(df, order_number(df, order), block)
    lasts = blocked.groupBy(*keys, _BLOCK).agg(F.max_by(value, order).alias("__last"))
    carried = lasts.select(
        *keys, _BLOCK, F.lag("__last").over(Window.partitionBy(*keys).orderBy(_BLOCK)).alias(_CARRIED)
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    return (
        blocked.join(carried, [*keys, _BLOCK])
        .withColumn(
            out,
            F.when(F.row_number().over(inside) == 1, F.col(_CARRIED)).otherwise(F.lag(value).over(inside)),
        )
        .drop(_BLOCK, _CARRIED)
    )


def trailing_sum(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: float, out: str,
    block_seconds: int = 3600,
) -> DataFrame:
    """``sum(value)`` over the half-open span ``(ts - seconds, ts]`` of the key.

    Time is cut into blocks; a row within ``seconds`` of the next block is also sent
    there as context, so each block is complete on its own.
    """
    keys, span, block = list(keys), round(seconds * 1_000_000), block_seconds * 1_000_000
    if span > block:
        raise ValueError("the block must be at least as long as the trailing span")
    at = F.unix_micros(ts)
    home = at - F.pmod(at, F.lit(block))
    after = home + F.lit(block)
    copied = df.withColumn("__at", at).withColumn("__home", home).withColumn(
        _BLOCK, F.explode(F.array_compact(F.array(home, F.when(at + span > after, after))))
    )
    frame = Window.partitionBy(*keys, _BLOCK).orderBy("__at").rangeBetween(-span + 1, 0)
    return (
        copied.withColumn(out, F.sum(value).over(frame))
        .where(F.col(_BLOCK) == F.col("__home"))
        .drop(_BLOCK, "__at", "__home")
    )


def last_at_or_before(
    markers: DataFrame, at: str, samples: DataFrame, keys: Sequence[str], ts: str, value: str, out: str, block_seconds: int = 3600,
) -> DataFrame:
    """As-of join: every marker with the newest sample of its key at or before it, null if there is none.

    Markers and samples are one scan: time is cut into blocks, each folded to its newest sample, and a window over those
    few rows carries it on; inside a block the newest sample so far is taken. No key is in one task.
    """
    keys, block = list(keys), block_seconds * 1_000_000
    kind = samples.schema[value].dataType
    left = markers.withColumns({"__at": F.unix_micros(at), "__value": F.lit(None).cast(kind), "__marker": F.lit(1)})
    right = samples.select(*keys, F.unix_micros(ts).alias("__at"), F.col(value).alias("__value"), F.lit(0).alias("__marker"))
    both = _with_block(left.unionByName(right, allowMissingColumns=True), F.col("__at"), block)
    newest = both.groupBy(*keys, _BLOCK).agg(F.max_by("__value", F.when(F.col("__marker") == 0, F.col("__at"))).alias("__newest"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*keys, _BLOCK, F.last("__newest", ignorenulls=True).over(earlier).alias(_CARRIED))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy("__at", "__marker").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        both.withColumn("__inside", F.last("__value", ignorenulls=True).over(inside)).join(carried, [*keys, _BLOCK])
        .where("__marker = 1").select(*markers.columns, F.coalesce("__inside", _CARRIED).alias(out))
    )
