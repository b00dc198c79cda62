"""From raw documents to token ids: language, near duplicates, benchmark passages, source mix, files of ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, language_id, mixing, token_ids
from tidemark.llm.common import pin, ready, table, text_key


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know: those without a letter and those rejected go."""
    ready(spark)
    found = language_id.identify(docs.select("text", F.struct("*").alias("row")), language_id.fit(docs))
    return found.where(~F.col("rejected")).select("row.*")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates; of rows that repeat its doc_id one. Rows without one stay."""
    ready(spark)
    first = pin(jaccard_join.similar_documents(docs).where("doc_id = class_id").select("doc_id").distinct())
    rows = docs.select("doc_id", text_key().alias("key"), F.struct("*").alias("row")).join(first, "doc_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
    return rows.withColumn("place", place).where("place = 1").select("row.*").unionAll(docs.where("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights take it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back: one row a document."""
    ready(spark)
    return token_ids.written(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", without_benchmarks),
    ("mixing sources", mixed_sources),
    ("token-ID output", tokens),
]
# Language models, MinHash and tokenizers are not SQL; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = pin(docs) if at < len(STAGES) - 1 else docs
    return docs
