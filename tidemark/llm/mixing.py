"""Mixing sources to target weights, with DataFrame functions only.

The sizes of documents are added up per source (aggregated before the shuffle), targets are derived from these few rows,
and each document is repeated floor(rate) times plus once more if a hash of its id falls below the rest of the rate. The
per-source table is joined back by source; where it is not small enough for Spark to broadcast, the join is a shuffled
one whose hot sources adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pin

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def words_in(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null last.

    Filling by weight until no target is above ``most`` times its source is a common level for all weights: sources are
    taken by the level at which they are full, and the level is what remains divided by the weight that remains.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    named = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the first source that is not full sets the level
    level = named.withColumn("level", left / weights).withColumn(
        "open", F.when(F.col("full") >= F.col("level") * F.col("weight"), F.col("level")))
    first = F.first("open", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("common", first).select(
        "source", "source_size",
        F.least(F.col("full").cast("double"), F.coalesce(F.col("common") * F.col("weight"), F.col("full").cast("double"))).alias("target"))


def chance(seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on seed and doc_id only; of a row without one, on its text."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    digest = F.md5(F.concat_ws("-", F.lit(seed), named))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mixed_sizes(docs: DataFrame, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target and ``copies``, the number of times the mix takes the row.

    Rows that repeat a doc_id share their chance, as do rows without one that repeat a text; a null source is a source of its own and comes last; a null or empty
    text has size 0. A source without words has target 0 and is not taken. Columns of ``docs`` that have the names of
    the added ones are replaced.
    """
    kept = docs.drop("size", "source_size", "target", "copies")
    sized = kept.withColumn("size", words_in())
    totals = pin(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most))
    totals = totals.withColumnRenamed("source", "_source")
    joined = sized.join(totals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    again = F.when(chance(seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", (F.floor(rate) + again).cast("int"))


def taken(docs: DataFrame, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): one row per input row."""
    return mixed_sizes(docs.select("doc_id", "source", "text"), share, most, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed rows, with the columns of ``docs`` whatever their names: each row as often as the mix takes it."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    return mixed_sizes(rows, share, most, seed).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (SELECT source, source_size, [3, 1, 2][(k - 1) % 3 + 1] AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), c AS (SELECT arg_min(level, 2 * source_size / weight) AS level FROM l WHERE 2 * source_size >= level * weight),
t AS (SELECT source, source_size, least(2 * source_size, c.level * weight)::DOUBLE AS target FROM l, c),
r AS (
  SELECT doc_id, size, source_size, target, target / source_size AS rate,
         ('0x' || substr(md5('{SEED}-' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS chance
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
