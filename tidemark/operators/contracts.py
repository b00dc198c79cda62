"""Contract checks: each record gets the array of rules it breaks (empty when clean)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import evaluated_once, exact_json
from tidemark.operators.decode import RFC3339, SCHEMA_VERSION, STATUSES
from tidemark.schemas import EVENT_FIELDS

BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
DEAD_LETTER_REQUIRED = (
    "failed_at", "reason", "error", "source_topic", "source_partition", "source_offset", "payload_base64",
)
DEAD_LETTER_FIELDS = (
    *DEAD_LETTER_REQUIRED, "source_key", "consumer_group", "event_id", "tenant_id", "source_id", "headers",
)


class _Document:
    """Typed access to one JSON document held as VARIANT."""

    def __init__(self, root: Column):
        self.root = root

    def value(self, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(self.root, f"$.{name}", kind)

    def kind(self, name: str) -> Column:
        """JSON type as text; NULL when the field is absent."""
        return F.schema_of_variant(F.try_variant_get(self.root, f"$.{name}", "variant"))

    def missing(self, name: str) -> Column:
        return self.kind(name).isNull()

    def keys(self) -> Column:
        return F.map_keys(F.try_variant_get(self.root, "$", "map<string,variant>"))


def _violations(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in rules]))


def _is_time(text: Column) -> Column:
    return text.rlike(RFC3339) & F.try_to_timestamp(text).isNotNull()


def contract_violations(df: DataFrame, col: str = "value") -> DataFrame:
    """Event contract: all fields present and typed, nothing extra, constants and ranges."""
    parsed = df.withColumn("__doc", exact_json(F.col(col).cast("string")))
    doc = _Document(F.col("__doc"))
    is_object = F.schema_of_variant("__doc").startswith("OBJECT<")
    rules: list[tuple[Column, str]] = [(doc.missing(n), f"{n}: required") for n in EVENT_FIELDS]
    for name in ("event_id", "tenant_id", "source_id", "region"):
        rules += [(doc.kind(name) != "STRING", f"{name}: type"), (doc.value(name) == "", f"{name}: minLength")]
    rules += [
        (doc.kind("schema_version") != "BIGINT", "schema_version: type"),
        (doc.value("schema_version", "bigint") != SCHEMA_VERSION, "schema_version: const"),
        (doc.kind("event_type") != "STRING", "event_type: type"),
        (doc.value("event_type") != "telemetry", "event_type: const"),
        (doc.kind("timestamp") != "STRING", "timestamp: type"),
        ((doc.kind("timestamp") == "STRING") & ~F.coalesce(_is_time(doc.value("timestamp")), F.lit(False)),
         "timestamp: format"),
        (~doc.kind("value").rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), "value: type"),
        (doc.kind("status") != "STRING", "status: type"),
        (~doc.value("status").isin(*STATUSES), "status: enum"),
        (doc.kind("sequence") != "BIGINT", "sequence: type"),
        (doc.value("sequence", "bigint") < 1, "sequence: minimum"),
    ]
    extra = F.array_except(doc.keys(), F.array(*[F.lit(n) for n in EVENT_FIELDS]))
    rules.append((F.size(extra) > 0, "additionalProperties"))
    found = F.when(F.coalesce(is_object, F.lit(False)), _violations(*rules)).otherwise(F.array(F.lit("type: object")))
    return parsed.withColumn("violations", evaluated_once(found)).drop("__doc")


def dead_letter_violations(df: DataFrame, col: str = "value") -> DataFrame:
    """Dead-letter contract over its JSON text."""
    parsed = df.withColumn("__doc", exact_json(F.col(col).cast("string")))
    doc = _Document(F.col("__doc"))
    is_object = F.schema_of_variant("__doc").startswith("OBJECT<")
    rules: list[tuple[Column, str]] = [(doc.missing(n), f"{n}: required") for n in DEAD_LETTER_REQUIRED]
    for name in ("reason", "error", "source_topic", "source_key", "consumer_group", "event_id",
                 "tenant_id", "source_id", "payload_base64", "failed_at"):
        rules.append((doc.kind(name) != "STRING", f"{name}: type"))
    for name in ("source_partition", "source_offset"):
        rules += [(doc.kind(name) != "BIGINT", f"{name}: type"), (doc.value(name, "bigint") < 0, f"{name}: minimum")]
    headers = doc.value("headers", "array<map<string,variant>>")

    def bad_header(h: Column) -> Column:
        key, value = F.schema_of_variant(h["key"]), F.schema_of_variant(h["value_base64"])
        return ~(
            F.coalesce(key == "STRING", F.lit(False)) & F.coalesce(value == "STRING", F.lit(False))
            & (F.size(F.map_keys(h)) == 2)
            & F.coalesce(F.try_variant_get(h["key"], "$", "string") != "", F.lit(False))
        )

    rules += [
        (doc.value("reason") == "", "reason: minLength"),
        (doc.value("source_topic") == "", "source_topic: minLength"),
        (~F.coalesce(_is_time(doc.value("failed_at")), F.lit(False)) & ~doc.missing("failed_at"), "failed_at: format"),
        (~doc.value("payload_base64").rlike(BASE64), "payload_base64: contentEncoding"),
        (~doc.missing("headers") & headers.isNull(), "headers: type"),
        (F.exists(headers, bad_header), "headers: items"),
        (F.size(F.array_except(doc.keys(), F.array(*[F.lit(n) for n in DEAD_LETTER_FIELDS]))) > 0,
         "additionalProperties"),
    ]
    found = F.when(F.coalesce(is_object, F.lit(False)), _violations(*rules)).otherwise(F.array(F.lit("type: object")))
    return parsed.withColumn("violations", evaluated_once(found)).drop("__doc")


# Evidence report: required fields by part (fixed values)
REPORT_TEXT = ("generated_at", "status", "artifact_root")
BENCHMARK_TEXT = ("artifact", "started_at_utc", "completed_at_utc", "summary")
BENCHMARK_NUMBERS = (
    "target_eps", "accepted_eps", "processed_eps", "query_p95_ms", "peak_lag", "post_load_drain_seconds",
    "producer_count", "processor_replicas", "batch_size",
)
DRILL_TEXT = (
    "scenario_id", "title", "status", "artifact", "started_at_utc", "completed_at_utc", "result",
    "operator_note", "remaining_gap",
)
_NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def report_violations(df: DataFrame, col: str = "value") -> DataFrame:
    """Evidence-report contract over its JSON text (a byte-order mark is allowed)."""
    text = F.regexp_replace(F.col(col).cast("string"), "^﻿", "")
    parsed = df.withColumn("__doc", exact_json(text))
    doc = _Document(F.col("__doc"))

    def part(path: str) -> Column:
        return F.try_variant_get(F.col("__doc"), path, "variant")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(part(path)), F.lit(""))

    rules = [(~F.coalesce(doc.value("schema_version", "double") == 1, F.lit(False)), "schema_version: const")]
    rules += [(kind(f"$.{n}") != "STRING", f"{n}: string") for n in REPORT_TEXT]
    has_benchmark = ~kind("$.benchmark").isin("", "VOID")
    rules.append((has_benchmark & ~kind("$.benchmark").startswith("OBJECT<"), "benchmark: object"))
    rules += [(has_benchmark & (kind(f"$.benchmark.{n}") != "STRING"), f"benchmark.{n}: string") for n in BENCHMARK_TEXT]
    rules += [
        (has_benchmark & ~(kind(f"$.benchmark.{n}").rlike(_NUMBER)
                           & (F.abs(F.try_variant_get(F.col("__doc"), f"$.benchmark.{n}", "double")) < float("inf"))),
         f"benchmark.{n}: number")
        for n in BENCHMARK_NUMBERS
    ]

    def array(path: str) -> Column:
        return F.try_variant_get(F.col("__doc"), path, "array<variant>")

    def sub_kind(v: Column, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit(""))

    def bad_text(v: Column, *names: str) -> Column:
        bad = F.lit(False)
        for name in names:
            bad = bad | (sub_kind(v, name) != "STRING")
        return bad

    def bad_optional(v: Column, *names: str) -> Column:
        bad = F.lit(False)
        for name in names:
            bad = bad | ~sub_kind(v, name).isin("", "STRING")
        return bad

    def bad_gate(v: Column) -> Column:
        numbers = ~sub_kind(v, "target").rlike(_NUMBER) | ~sub_kind(v, "observed").rlike(_NUMBER)
        return bad_text(v, "name", "status") | numbers | bad_optional(v, "unit")

    def bad_metric(v: Column) -> Column:
        return bad_text(v, "label", "value") | bad_optional(v, "unit", "tone")

    def bad_drill(v: Column) -> Column:
        metrics = F.try_variant_get(v, "$.metrics", "array<variant>")
        return bad_text(v, *DRILL_TEXT) | metrics.isNull() | F.exists(metrics, bad_metric)

    rules += [
        (has_benchmark & array("$.benchmark.gaps").isNull(), "benchmark.gaps: array"),
        (has_benchmark & F.exists(array("$.benchmark.gaps"), lambda g: F.schema_of_variant(g) != "STRING"),
         "benchmark.gaps: items"),
        (has_benchmark & array("$.benchmark.gates").isNull(), "benchmark.gates: array"),
        (has_benchmark & F.exists(array("$.benchmark.gates"), bad_gate), "benchmark.gates: items"),
        (array("$.failure_drills").isNull(), "failure_drills: array"),
        (F.exists(array("$.failure_drills"), bad_drill), "failure_drills: items"),
    ]
    is_object = F.schema_of_variant("__doc").startswith("OBJECT<")
    found = F.when(F.coalesce(is_object, F.lit(False)), _violations(*rules)).otherwise(F.array(F.lit("type: object")))
    return parsed.withColumn("violations", evaluated_once(found)).drop("__doc")
