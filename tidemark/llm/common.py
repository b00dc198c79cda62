"""Helpers the operators share: words, hashes in numpy, intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare, shared_dir

U64 = np.uint64
CACHED_WORDS = 1 << 18  # some 35 MB
KEPT_POWERS = 1 << 20
# Arrow batches of whole texts are bounded by their bytes, not only by Spark's 10,000 rows
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
FRAME_ROWS = 1 << 16
# on a folder of this machine Hadoop starts a process for each file it makes, checksum files included; other stores ignore this
_NO_CHECKSUM_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the path of Python workers that start in another folder.

    A cluster of several machines gets the package with ``--py-files`` or an installation, as usual.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set(*BATCH_BYTES)
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pin(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    It cuts the lineage: a lost executor costs no more than the stage it was in. The files go when the
    application ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "tidemark-llm", uuid.uuid4().hex)
    df.write.options(**_NO_CHECKSUM_FILES).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


class WordHashes(dict):
    """64-bit hashes of words (bytes); bounded, as it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text; none of a null."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalised 64-bit values: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Runs:
    """Hashes of any run of consecutive values, by prefix sums of a polynomial modulo 2**64."""

    powers = np.ones(1, U64)
    inverses = np.ones(1, U64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        self.powers, self.inverses = Runs.powers, Runs.inverses
        if n > len(self.powers):
            size = 1 << n.bit_length()
            self.powers = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE, U64)])
            self.inverses = np.cumprod(np.r_[U64(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), U64)])
            if size <= KEPT_POWERS:  # those of a longer text go with it
                Runs.powers, Runs.inverses = self.powers, self.inverses
        self.sums = np.zeros(n, U64)
        np.cumsum(values * self.powers[: n - 1], out=self.sums[1:])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverses[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, U64)
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverses[:n])


def shingles(values: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter non-empty text is one shingle."""
    return np.unique(Runs(values).grams(min(size, len(values)))) if len(values) else np.empty(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 that a long column holds."""
    return np.ascontiguousarray(x).view(np.int64)


def chunks(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches of a ``mapInPandas`` function in pieces of at most ``rows`` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def stacked(parts: Iterable[dict[str, np.ndarray]], names: list[str]) -> pd.DataFrame:
    """One frame from column arrays made per document."""
    parts = list(parts)
    return pd.DataFrame({n: np.concatenate([p[n] for p in parts]) if parts else [] for n in names})


def stacks(parts: Iterable[dict[str, np.ndarray]], names: list[str], rows: int = FRAME_ROWS) -> Iterator[pd.DataFrame]:
    """The same in frames of at most ``rows`` rows, made as the parts come."""
    held, n = [], 0
    for part in parts:
        at, size = 0, len(part[names[0]])
        while at < size:
            end = min(size, at + rows - n)
            held.append({name: part[name][at:end] for name in names})
            at, n = end, n + end - at
            if n == rows:
                yield stacked(held, names)
                held, n = [], 0
    if held:
        yield stacked(held, names)


def text_key(text: str = "text") -> F.Column:
    """Tells rows that repeat a doc_id with another text apart."""
    return F.xxhash64(F.col(text))


def with_plain_id(df: DataFrame, *columns: str | F.Column) -> DataFrame:
    """doc_id without nulls, for pandas (which would turn it into a float), and ``no_id`` to undo it."""
    return df.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.isnull("doc_id").alias("no_id"), *columns)


def with_own_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
