"""Line dedup by distinct-site spread, with DataFrame functions only.

Every line hash gets a HyperLogLog sketch of the sites (sources) on which it stands; partial sketches merge in the
aggregation. Where the estimate is clearly above the threshold the line is boilerplate, clearly below it is not; lines
within the sketch's error of the threshold get exact distinct counts. Boilerplate is joined back as (document, position)
pairs without any text; the texts are shuffled once, to be put together without the lines that go.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pin, text_key

SITES = 10
LG_K = 12
ERRORS = 4  # standard errors within which an estimate counts as near the threshold


def lines_of(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row a line that has more than white space, with two independent hashes of it."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.col(site).alias("site"), F.posexplode(lines_of()).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc_id", "text_key", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def spread_lines(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines that stand on at least ``sites`` distinct sites."""
    margin = max(1.0, ERRORS * 1.04 / math.sqrt(2**lg_k) * sites)
    estimated = pin(
        lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"))
        .where(F.col("estimate") >= sites - margin)
    )
    clear = estimated.where(F.col("estimate") > sites + margin).select("h1", "h2")
    near = estimated.where(F.col("estimate") <= sites + margin).select("h1", "h2")
    exact = (
        lines.where("site is not null").join(near, ["h1", "h2"]).select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    )
    return clear.unionAll(exact)


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): every text less the lines that stand on ``sites`` or more distinct sites.

    All places of such a line go, the first too. Lines end at a line feed and are compared as they are; lines of white
    space only always stay. A null site is no site. One row per input row: a null text has no lines and an empty
    ``kept``; an empty one has one line. Further columns are ignored.
    """
    lines = pin(_lines(docs.where("doc_id is not null and text is not null"), site))
    boilerplate = pin(spread_lines(lines, sites, lg_k))
    gone = lines.join(boilerplate, ["h1", "h2"]).groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("gone"))
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).join(gone, ["doc_id", "text_key"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines_of(), lambda line, at: ~F.array_contains("gone", at)), "\n"))
    return rows.select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of())).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(kept, F.lit("")).alias("kept"))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents
), b AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= {SITES}
)
SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b ON l.line = b.line GROUP BY doc_id
"""
