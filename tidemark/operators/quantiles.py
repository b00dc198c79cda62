"""Exact order statistics without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 256
SLICES = 4096


def _bucket(value: Column) -> Column:
    """Order-preserving logarithmic bucket; wide value ranges stay a few thousand buckets."""
    size = F.floor(F.log1p(F.abs(value)) * RESOLUTION)
    return F.when(value < 0, -size).otherwise(size).cast("bigint")


def _slice(value: Column) -> Column:
    """Position inside the bucket's own value range, in ``SLICES`` equal steps."""
    share = F.try_divide(value - F.col("__lo"), F.col("__top") - F.col("__lo"))
    return F.coalesce(F.floor(share * SLICES), F.lit(0)).cast("bigint")


def _running(cells: DataFrame, group: list[str], order: str) -> DataFrame:
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("__hi", F.sum("__c").over(upto))


def _holding(counted: DataFrame, rank: str) -> DataFrame:
    """Cells that hold the rank; the rank becomes relative to the cell's first row."""
    first = F.col("__hi") - F.col("__c")
    held = counted.where((F.col(rank) < F.col("__hi")) & (F.col(rank) >= first))
    return held.withColumn(rank, F.col(rank) - first)


def _pick(df: DataFrame, keys: list[str], value: str, targets: list[Column]) -> DataFrame:
    """Values at zero-based ranks given as expressions over the row count ``n``.

    Counting narrows down where each rank lies: first among buckets of the whole range,
    then among slices of that bucket, last among the distinct values of that slice. Each
    step sees map-side folded counts, so no task holds the rows of a key.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull()).withColumn("__b", _bucket(v))
    buckets = rows.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__c"), F.min(v).alias("__lo"), F.max(v).alias("__top"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), t.cast("bigint").alias("rank")) for i, t in enumerate(targets)])
    in_bucket = _holding(
        _running(buckets, keys, "__b").withColumn("n", F.sum("__c").over(Window.partitionBy(*keys)))
        .withColumn("t", F.explode(wanted)).select("*", "t.*"), "rank",
    ).select(*keys, "__b", "i", "n", "rank", "__lo", "__top")

    group = [*keys, "__b"]
    sliced = rows.join(in_bucket.select(*group, "__lo", "__top").distinct(), group).withColumn("__s", _slice(v))
    slices = sliced.groupBy(*group, "__s").agg(F.count(F.lit(1)).alias("__c"))
    in_slice = _holding(
        _running(slices, group, "__s").join(in_bucket.select(*group, "i", "n", "rank"), group), "rank"
    ).select(*group, "__s", "i", "n", "rank")

    group = [*group, "__s"]
    distinct = sliced.join(in_slice.select(*group).distinct(), group, "left_semi").groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("__c"))
    found = _holding(_running(distinct, group, value).join(in_slice, group), "rank")
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("i") == i, v)).alias(f"q{i}") for i in range(len(targets))
    ])


def _named(picked: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    return picked.select(*keys, F.col("n").alias("value_count"), *[
        F.col(f"q{i}").alias(name) for i, name in enumerate(names)
    ])


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = (50, 95, 99),
) -> DataFrame:
    """Percentile by nearest rank: element ``ceil(p * n)``, one-based."""
    targets = [
        F.greatest(F.ceil(F.lit(p / 100.0) * F.col("n")) - 1, F.lit(0)) for p in percentiles
    ]
    return _named(_pick(df, list(keys), value, targets), list(keys), [f"p{p:g}" for p in percentiles])


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key; each map task forwards at most ``n`` per key.

    For keys that takes ``windowGroupLimitThreshold`` of at least ``n`` (``prepare`` sets the largest
    window used here); without keys it is a sort with a limit.
    """
    if not keys:
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")


def rolling_quantiles(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 4096,
    quantiles: Sequence[float] = (0.50, 0.95, 0.99),
) -> DataFrame:
    """Quantiles of the last ``n`` values: element ``int((count - 1) * q)``, zero-based.

    The window size bounds the group, so one sorted array per key is enough.
    """
    recent = last_rows(df, keys, order, n).groupBy(*keys).agg(
        F.sort_array(F.collect_list(value)).alias("__v")
    )
    size = F.size("__v")
    return recent.select(*keys, size.cast("bigint").alias("value_count"), *[
        F.coalesce(F.get("__v", F.floor((size - 1) * F.lit(q)).cast("int")), F.lit(0.0)).alias(f"p{q * 100:g}")
        for q in quantiles
    ])
