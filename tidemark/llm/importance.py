"""Resampling documents towards a target distribution, by hashed runs of words.

An untrained split of the tokenizers library cuts the ASCII-lowered text into words with offsets. Windows of one to three
consecutive pairs give a bucket each, the crc32 of their words joined by one space modulo 10,000. Bucket histograms of all
documents and of the target texts give every bucket a gain; a document weighs the sum of the gains of its windows, and
the highest weights plus Gumbel noise of the doc_id are drawn.

Every text is split once: the buckets of its windows are kept, two bytes each, in the shared folder. The histograms are
summed in each task first, so 10,000 rows a task are shuffled and 10,000 gains, whatever the input, go to the
workers. Ranks come from one sort by ranges and the row counts of its partitions; no task sees all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from tidemark.llm.common import pin, text_key

BUCKETS = 10_000  # at most 65,536, as a bucket is kept in two bytes
WIDEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE_BITS = 33  # monotonically_increasing_id has the partition above, the row within it below


@cache
def _splitter() -> Split:
    return Split(Regex(BETWEEN_WORDS), "removed")


def words_with_offsets(text: str) -> list[tuple[str, tuple[int, int]]]:
    """Words of the text, A-Z lower-cased, each with its start and end in characters."""
    return _splitter().pre_tokenize_str(text.encode().lower().decode())


def window_buckets(pairs: list[tuple[str, tuple[int, int]]], widest: int = WIDEST, buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each size from 1 to ``widest`` the buckets of all windows of so many pairs, by place of their first pair.

    The window of size n at place i spans ``pairs[i][1][0]`` to ``pairs[i + n - 1][1][1]``. Its crc32 goes on from that
    of the window one pair shorter.
    """
    words = [word.encode() for word, _ in pairs]
    later = [b" " + word for word in words]
    sums, found = list(map(zlib.crc32, words)), []
    for size in range(1, widest + 1):
        found.append((np.array(sums, np.uint32) % buckets).astype(np.uint16))
        sums = list(map(zlib.crc32, later[size:], sums))
    return found


def bucketed(docs: DataFrame, widest: int = WIDEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, key, n_words, n_features, windows): windows holds the buckets of all windows of the whole text."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame.pop("text"):
                pairs = words_with_offsets(text)
                found = np.concatenate(window_buckets(pairs, widest, buckets))
                out.append((len(pairs), len(found), found.tobytes()))
            yield frame.assign(**dict(zip(("n_words", "n_features", "windows"), zip(*out)))) if out else frame.reindex(
                columns=["doc_id", "key", "n_words", "n_features", "windows"])

    # the id goes as text, since pandas has no nulls in whole numbers
    rows = docs.select(F.col("doc_id").cast("string"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(split, "doc_id string, key long, n_words long, n_features long, windows binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def histogram(rows: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ``name``): how many windows of all rows fall into each bucket."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(buckets, np.int64)
        for frame in frames:
            for windows in frame["windows"]:
                sums += np.bincount(np.frombuffer(windows, np.uint16), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": at, "n": sums[at]})

    return rows.select("windows").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, s) and (bucket, t)."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(above / below)).alias("gain"))


def weighed(rows: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight) from the rows of ``bucketed`` and the gains."""
    of = np.zeros(buckets, np.int64)
    for row in gain.collect():  # ``buckets`` rows
        of[row["bucket"]] = row["gain"]
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            windows = frame.pop("windows")
            yield frame.assign(weight=[int(shared.value[np.frombuffer(w, np.uint16)].sum()) for w in windows])

    kind = rows.schema["doc_id"].dataType
    plain = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = plain.mapInPandas(weigh, "doc_id string, key long, n_words long, n_features long, weight long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def noise(seed: str = SEED) -> F.Column:
    """Gumbel noise in thousandths, rounded down, of seed and doc_id only."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... for the drawn share of the rows with enough words, null for the others."""
    able = F.col("n_words") >= least_words
    # a row's number tells rows of one id apart, so that ranges can part them
    own = pin(rows.withColumn("able", able).withColumn("row", F.monotonically_increasing_id()))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("key"), F.asc("row")]
    placed = pin(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", PLACE_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("able").alias("n_able"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pin(counts.select(  # one row a partition
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n_able").over(Window.partitionBy()).alias("all_able")))
    place = F.col("before") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    drawn = F.col("able") & (place <= F.floor(F.col("all_able") * percent / 100))
    numbered = placed.withColumn("part", part).join(starts, "part")
    return numbered.withColumn("rank", F.when(drawn, place)).drop("part", "place", "row", "able", "before", "all_able")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, key, n_words, n_features, weight, score, rank): one row per row of ``docs``, ``key`` a hash of its text.

    Drawn are floor(percent * N / 100) of the N rows with at least ``least_words`` words. A null or empty text has no
    words, weight 0 and no rank. A null doc_id is hashed as nothing after the colon and loses ties; rows that repeat a
    doc_id share their noise and are drawn each for itself, tied ones by number of windows and hash of the text.
    Documents without a target, or without rows, give gains from what there is. Other columns play no part.
    """
    rows = pin(bucketed(docs))
    gain = gains(histogram(rows, "s"), histogram(bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), "t"))
    return ranked(weighed(rows, gain).withColumn("score", F.col("weight") + noise(seed)), least_words, percent)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, whatever their names; of equal rows as many as were drawn."""
    found = importance(docs, target, percent, least_words, seed).where("rank is not null")
    times = pin(found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_times")))
    rows = docs.select("doc_id", text_key().alias("key"), F.struct("*").alias("row"))
    met = rows.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")))
    place = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("key"))
    return met.withColumn("place", place).where("place <= _times").select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


ORACLE = r"""
WITH texts AS (
  SELECT 's' AS side, doc_id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark
), d AS (
  SELECT row_number() OVER () AS n, side, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), f AS (
  SELECT n, side, unnest(list_concat(
    w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature
  FROM d
), g AS (SELECT n, side, feature, count(*) AS c FROM f GROUP BY ALL),
crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step
), hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM g)),
b AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i+1])::BIGINT)),
    lambda a, x: xor(a >> 8, step[xor(a & 255, x) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc
), counted AS (
  SELECT bucket, coalesce(sum(c) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(c) FILTER (WHERE side = 't'), 0) AS t
  FROM g JOIN b USING (feature) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counted
), weighed AS (
  SELECT n, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight
  FROM g JOIN b USING (feature) JOIN gains USING (bucket) WHERE side = 's' GROUP BY n
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (n) WHERE side = 's'
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= floor(5 * total / 100) THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
             count(*) FILTER (WHERE n_words >= 20) OVER () AS total FROM scored)
"""
