"""Gates, gap messages, drill verdicts and the evidence summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scans import last_at_or_before
from tidemark.schemas import GATE, METRIC

# Gates: name, target, observed column, unit, pass test (fixed values)
GATES = (
    ("processed_eps_2000", 2000.0, "processed_eps", "eps", ">="),
    ("processed_eps_5000", 5000.0, "processed_eps", "eps", ">="),
    ("query_p95_250ms", 250.0, "query_p95_ms", "ms", "<="),
    ("post_load_drain_30s", 30.0, "post_load_drain_seconds", "s", "<="),
)

# Gap messages (fixed values)
GAP_ACCEPTED = "Accepted throughput is below 80 percent of target; producer or ingest path is still the bottleneck."
GAP_BELOW_2000 = "Processed throughput is below the next credibility gate of 2,000 eps."
GAP_BELOW_5000 = "Processed throughput cleared the 2,000 eps gate but remains below the MVP target of 5,000 eps."
GAP_LAG = (
    "Peak consumer lag exceeded 50,000 messages; drain capacity needs more work before claiming strong "
    "sustained throughput."
)
GAP_DRAIN = "Post-load drain exceeded 30 seconds; processor capacity does not yet clear backlog quickly."
GAP_NONE = (
    "No benchmark gate failed in the latest artifact; repeat on clean state before making a broader capacity claim."
)


def gates(rules: tuple = GATES) -> Column:
    """Array of gate results over the report columns a rule names."""
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.when(F.col(column) >= target if test == ">=" else F.col(column) <= target, "pass").otherwise("fail").alias("status"),
            F.lit(target).alias("target"),
            F.col(column).cast("double").alias("observed"),
            F.lit(unit).alias("unit"),
        )
        for name, target, column, unit, test in rules
    ]).cast(T.ArrayType(GATE))


def evaluate_gates(reports: DataFrame, rules: tuple = GATES) -> DataFrame:
    """One row per report and gate."""
    return reports.withColumn("gate", F.explode(gates(rules))).select("run_id", "gate.*")


def gap_messages() -> Column:
    """Array of what a report falls short of; one reassuring line when nothing."""
    processed = F.col("processed_eps")
    found = F.array_compact(F.array(
        F.when((F.col("target_eps") > 0) & (F.col("accepted_eps") < F.col("target_eps") * 0.8), GAP_ACCEPTED),
        F.when(processed < 2000, GAP_BELOW_2000).when(processed < 5000, GAP_BELOW_5000),
        F.when(F.col("peak_lag") > 50_000, GAP_LAG),
        F.when(F.col("post_load_drain_seconds") > 30, GAP_DRAIN),
    ))
    return F.when(F.size(found) == 0, F.array(F.lit(GAP_NONE))).otherwise(found)


def show_number(value: Column, digits: int = 0) -> Column:
    """Grouped thousands, fixed digits, halves away from zero."""
    return F.format_number(F.round(value.cast("double"), digits), digits)


def show_time(text: Column) -> Column:
    """UTC with seven fraction digits; text that is no time stays as it is."""
    return F.coalesce(
        F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'"), text, F.lit("")
    )


def _plain(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit(""))


def _flag(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


REPORT = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "started_at_utc", "started_at", "completed_at_utc", "finished_at")]
    + [T.StructField(n, T.BooleanType()) for n in (
        "lag_recovered_within_window", "accepted_recovered_within_window", "processed_recovered_within_window",
        "duplicate_safe", "rebuild_restored")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "recovery_seconds", "processed_recovery_seconds", "peak_consumer_lag", "final_consumer_lag",
        "accepted_total_delta", "processed_total_delta", "archive_accounting_gap", "publish_failed_total_delta",
        "backpressure_total_delta", "overview_failure_count", "peak_overview_latency_ms",
        "replay_response_replayed", "verifier_duplicate_delta_after_replay", "source_metric_overcount_delta",
        "rebuild_replay_response_replayed", "dead_letter_delta", "consumer_lag_before", "consumer_lag_after",
        "rate_target_eps", "accepted_eps", "processed_eps", "post_load_drain_seconds", "query_latency_p95_ms",
        "processor_replicas_observed", "producer_count", "batch_size")]
)

# Scenarios: id, title, artifact name prefix, operator note, remaining gap when verified,
# remaining gap when degraded (fixed values)
SCENARIOS = (
    ("restart-processor", "Processor restart", "restart-processor-",
     "Consumer group recovery is observable through lag, processed delta, and replica count.",
     "Repeat at higher load and replica counts.",
     "Increase drain capacity or extend the observation window before claiming fast recovery."),
    ("broker-outage", "Broker outage", "broker-outage-",
     "Publish failures and backpressure are explicit, and the processor should remain live while Kafka is unavailable.",
     "Client-side timeout counts still require log parsing before they are first-class evidence.",
     "Client-side timeout counts still require log parsing before they are first-class evidence."),
    ("pause-postgres", "Postgres pause", "pause-postgres-",
     "The drill captures write-path degradation, read-path failure, and recovery timing.",
     "Final lag and producer timeouts still define the overload cleanup work.",
     "Final lag and producer timeouts still define the overload cleanup work."),
    ("replay-archive", "Replay rebuild", "replay-archive-",
     "Replay republishes archive records through the same Kafka and processor path.",
     "Repeat replay drills against the tenant/hour indexed archive layout under larger data volumes.",
     "Repeat replay drills against the tenant/hour indexed archive layout under larger data volumes."),
    ("poison-message", "Poison message", "inject-poison-message-",
     "A poison Kafka record should be isolated into the DLQ without blocking the processor loop.",
     "Add dashboard-level drill trigger only after the evidence endpoint remains stable.",
     "Add dashboard-level drill trigger only after the evidence endpoint remains stable."),
)
# What a scenario without a report says (fixed values)
MISSING = (
    "No artifact found for this drill.",
    "Run the matching script under scripts/chaos to generate evidence.",
    "Evidence is not yet reproducible for this scenario.",
)
# Metrics by scenario: label, report field, digits, unit (fixed values)
DRILL_METRICS = {
    "restart-processor": (
        ("accepted delta", "accepted_total_delta", 0, None), ("processed delta", "processed_total_delta", 0, None),
        ("peak lag", "peak_consumer_lag", 0, None), ("final lag", "final_consumer_lag", 0, None)),
    "broker-outage": (
        ("accepted delta", "accepted_total_delta", 0, None), ("publish failed", "publish_failed_total_delta", 0, None),
        ("backpressure", "backpressure_total_delta", 0, None), ("peak lag", "peak_consumer_lag", 0, None)),
    "pause-postgres": (
        ("processed delta", "processed_total_delta", 0, None), ("overview failures", "overview_failure_count", 0, None),
        ("peak API latency", "peak_overview_latency_ms", 2, "ms"), ("final lag", "final_consumer_lag", 0, None)),
    "replay-archive": (
        ("replayed duplicates", "replay_response_replayed", 0, None),
        ("duplicate delta", "verifier_duplicate_delta_after_replay", 0, None),
        ("overcount delta", "source_metric_overcount_delta", 0, None),
        ("rebuild replayed", "rebuild_replay_response_replayed", 0, None)),
    "poison-message": (
        ("DLQ delta", "dead_letter_delta", 0, None), ("lag before", "consumer_lag_before", 0, None),
        ("lag after", "consumer_lag_after", 0, None)),
}


def latest_reports(files: DataFrame) -> DataFrame:
    """Newest report per kind: ``files(kind, artifact, modified_at, payload)``."""
    newest = F.max_by(F.struct("artifact", "payload"), F.struct("modified_at", "artifact"))
    return files.groupBy("kind").agg(newest.alias("f")).select("kind", "f.*")


def _verdicts(r: Column) -> dict[str, tuple[Column, Column]]:
    """Per scenario: verified or not, and the result line."""
    def flag(name: str) -> Column:
        return F.coalesce(r[name], F.lit(False))

    def number(name: str) -> Column:
        return F.coalesce(r[name], F.lit(0.0))

    gap = number("archive_accounting_gap").cast("bigint")
    dead = number("dead_letter_delta").cast("bigint")
    lag_ok, accepted_ok = flag("lag_recovered_within_window"), flag("accepted_recovered_within_window")
    processed_ok = flag("processed_recovered_within_window")
    return {
        "restart-processor": (lag_ok, F.when(
            lag_ok, F.concat(F.lit("Lag recovered in "), _plain(r["recovery_seconds"]), F.lit(" seconds.")),
        ).otherwise("Processor restarted, but lag did not drain inside the observation window.")),
        "broker-outage": ((gap == 0) & accepted_ok, F.concat(
            F.lit("Archive accounting gap "), gap, F.lit("; accepted traffic recovered: "), _flag(accepted_ok), F.lit("."))),
        "pause-postgres": (processed_ok, F.when(processed_ok, F.concat(
            F.lit("Processor progress recovered in "), _plain(r["processed_recovery_seconds"]),
            F.lit(" seconds after Postgres became ready."),
        )).otherwise("Processor progress did not recover inside the observation window.")),
        "replay-archive": (flag("duplicate_safe") & flag("rebuild_restored"), F.concat(
            F.lit("Duplicate-safe: "), _flag(flag("duplicate_safe")), F.lit("; rebuild restored: "),
            _flag(flag("rebuild_restored")), F.lit("."))),
        "poison-message": (dead > 0, F.concat(F.lit("Dead-letter delta "), dead, F.lit("."))),
    }


def dead_letter_delta(drills: DataFrame, snapshots: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``drills(started_at, finished_at, ...)`` with the dead letters that came in between.

    ``snapshots(sample_ts, value)`` hold running totals; counted is the difference of the newest ones at or before each
    marker, and a total is 0 before its first snapshot.
    """
    before = last_at_or_before(drills, "started_at", snapshots, keys, "sample_ts", "value", "__before")
    after = last_at_or_before(before, "finished_at", snapshots, keys, "sample_ts", "value", "__after")
    zero = F.lit(0)
    delta = (F.coalesce("__after", zero) - F.coalesce("__before", zero)).cast("bigint")
    return after.withColumn("dead_letter_delta", delta).drop("__before", "__after")


def drill_summary(files: DataFrame) -> DataFrame:
    """One row per scenario, in fixed order (``position``): verified, degraded or missing."""
    spark = files.sparkSession
    scenarios = spark.createDataFrame(
        [(i, sid, title, prefix.rstrip("-"), note, good, bad) for i, (sid, title, prefix, note, good, bad) in enumerate(SCENARIOS)],
        "position int, scenario_id string, title string, kind string, note string, gap_good string, gap_bad string",
    )
    joined = scenarios.join(latest_reports(files), "kind", "left").withColumn("r", F.from_json("payload", REPORT))
    r, found = F.col("r"), F.col("artifact").isNotNull()
    verified, result = F.lit(False), F.lit(MISSING[0])
    metrics = F.array().cast(T.ArrayType(METRIC))
    for sid, (ok, line) in _verdicts(r).items():
        here = F.col("scenario_id") == sid
        verified = F.when(here, ok).otherwise(verified)
        result = F.when(here & found, line).otherwise(result)
        rows = F.array(*[
            F.struct(
                F.lit(label).alias("label"), show_number(F.coalesce(r[field], F.lit(0.0)), digits).alias("value"),
                F.lit(unit).cast("string").alias("unit"), F.lit(None).cast("string").alias("tone"))
            for label, field, digits, unit in DRILL_METRICS[sid]
        ]).cast(T.ArrayType(METRIC))
        metrics = F.when(here & found, rows).otherwise(metrics)
    blank = F.lit("")
    return joined.select(
        "position", "scenario_id", "title",
        F.when(~found, "missing").when(verified, "verified").otherwise("degraded").alias("status"),
        F.coalesce("artifact", blank).alias("artifact"),
        show_time(F.coalesce(r["started_at_utc"], r["started_at"])).alias("started_at_utc"),
        show_time(F.coalesce(r["completed_at_utc"], r["finished_at"])).alias("completed_at_utc"),
        result.alias("result"),
        F.when(found, F.col("note")).otherwise(MISSING[1]).alias("operator_note"),
        F.when(~found, MISSING[2]).when(verified, F.col("gap_good")).otherwise(F.col("gap_bad")).alias("remaining_gap"),
        metrics.alias("metrics"),
    )


def benchmark_evidence(files: DataFrame) -> DataFrame:
    """The newest benchmark report as an evidence block (no row when there is none)."""
    r = F.col("r")

    def number(name: str, default: float = 0.0) -> Column:
        return F.coalesce(r[name], F.lit(default))

    reports = latest_reports(files.where(F.col("kind") == "benchmark")).withColumn("r", F.from_json("payload", REPORT))
    flat = reports.select(
        "artifact",
        show_time(r["started_at_utc"]).alias("started_at_utc"),
        show_time(r["completed_at_utc"]).alias("completed_at_utc"),
        number("rate_target_eps").alias("target_eps"), number("accepted_eps").alias("accepted_eps"),
        number("processed_eps").alias("processed_eps"), number("query_latency_p95_ms").alias("query_p95_ms"),
        number("peak_consumer_lag").cast("bigint").alias("peak_lag"),
        # a report without a drain time counts as never drained
        number("post_load_drain_seconds", 999_999.0).alias("post_load_drain_seconds"),
        number("producer_count", 1.0).cast("bigint").alias("producer_count"),
        number("processor_replicas_observed").cast("bigint").alias("processor_replicas"),
        number("batch_size", 1.0).cast("bigint").alias("batch_size"),
    )
    summary = F.concat(
        F.lit("Accepted "), show_number(F.col("accepted_eps"), 1), F.lit(" eps and processed "),
        show_number(F.col("processed_eps"), 1), F.lit(" eps against a "), show_number(F.col("target_eps"), 0),
        F.lit(" eps target using "), F.col("producer_count"), F.lit(" producer(s), "), F.col("processor_replicas"),
        F.lit(" processor replica(s), and batch size "), F.col("batch_size"), F.lit("."),
    )
    return flat.select("*", summary.alias("summary"), gap_messages().alias("gaps"), gates().alias("gates"))


def evidence_summary(files: DataFrame, artifact_root: str, generated_at: Column) -> DataFrame:
    """The whole report as one row: five scenarios and at most one benchmark."""
    drills = drill_summary(files).withColumn("kind", F.lit("drill"))
    names = [c for c in drills.columns if c not in ("position", "kind")]
    drill_rows = drills.select(F.struct("position", F.struct(*names).alias("d")).alias("drill"))
    bench_rows = benchmark_evidence(files)
    bench = bench_rows.select(F.struct(*bench_rows.columns).alias("benchmark"))
    both = drill_rows.unionByName(bench, allowMissingColumns=True)
    return both.agg(
        F.first("benchmark", ignorenulls=True).alias("benchmark"),
        F.transform(F.sort_array(F.collect_list("drill")), lambda x: x["d"]).alias("failure_drills"),
    ).select(
        F.lit(1).alias("schema_version"), generated_at.alias("generated_at"), F.lit("available").alias("status"),
        F.lit(artifact_root).alias("artifact_root"), "benchmark", "failure_drills",
    )
