"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    conversation_repair, decontaminate, importance, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, mixing, quality_rules,
    substring_dedup, token_ids, top_k,
)
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.without_duplicates(_documents(spark, sf_dir)))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.written(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, F.col("vec_id") % top_k.QUERY_EVERY == 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.without_boilerplate(_documents(spark, sf_dir)))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(_documents(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = language_id.held_out().alias("held_out")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(importance.importance(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audited(conversation_repair.damaged(conversations), conversations)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.verdicts(_documents(spark, sf_dir), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_substring_dedup, op2_token_ids, op3_top_k, op4_license_scan, op5_line_dedup, op6_lm_scoring,
    op7_source_mixing, op8_jaccard_join, op9_decontamination, op10_language_id, op11_importance_resampling,
    op12_conversation_repair, op13_quality_rules,
)}
ORACLE: dict[str, str] = {
    "op3_top_k": top_k.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op7_source_mixing": mixing.ORACLE,
    "op9_decontamination": decontaminate.ORACLE, "op11_importance_resampling": importance.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE, "op13_quality_rules": quality_rules.ORACLE,
}
