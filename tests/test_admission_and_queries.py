import datetime as dt

import pytest
from helpers import payload, rows
from pyspark.sql import functions as F

from tidemark.operators.admission import ADMIN, SERVICE, TENANT_USER, Principal, admit_batches, admit_single, admitted_events
from tidemark.operators.deadletters import dead_letter_log, to_dead_letters
from tidemark.operators.decode import classify
from tidemark.operators.rejections import BAD_PAYLOAD, rejection_counts, to_rejections
from tidemark.plans import queries as q
from tidemark.plans.scope import Forbidden, requested_tenant, scoped
from tidemark.schemas import LOG_MESSAGE, VIEWS
from tidemark.sources.evidence import latest_per_key, read_evidence, read_report_files, read_samples, write_report

ADMINISTRATOR, OWNER = Principal(ADMIN), Principal(TENANT_USER, "harbour")
NOW = dt.datetime(2026, 4, 10, 12, 0)


def verdicts(spark, bodies, principal):
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id int, body string")
    return {r["request_id"]: (r["reason"], r["pos"], r["tenant_id"]) for r in admit_batches(df, principal).collect()}


def test_batches_are_all_or_nothing(spark):
    good, bad, foreign = payload(), payload(sequence=0), payload(tenant_id="tenant_2")
    bodies = [
        f"[{good}]", f"[{good},{bad}]", f"[{good},{payload(x=1)},{bad}]", "[]", "{}", f"[{good}] x", f"[{good}][{good}]",
        f"[{','.join([good] * 501)}]", f"[{','.join([good] * 500)}]", f"[{good},{foreign}]", f'["{{}}"]', f"[{good}]]",
    ]
    want = [
        (None, None, None), ("validation_failed", 1, "harbour"), ("decode_failed", 1, None), ("validation_failed", -1, None),
        ("decode_failed", -1, None), ("decode_failed", -1, None), ("decode_failed", -1, None), ("validation_failed", -1, None),
        (None, None, None), (None, None, None), ("decode_failed", 0, None), ("decode_failed", -1, None),
    ]
    assert verdicts(spark, bodies, ADMINISTRATOR) == dict(enumerate(want))
    assert verdicts(spark, [f"[{good},{foreign}]", f"[{bad},{foreign}]"], OWNER) == {
        0: ("forbidden", 1, None), 1: ("validation_failed", 0, "harbour")}
    assert verdicts(spark, [f"[{good}]"], Principal("viewer"))[0][0] == "forbidden"


def test_admitted_events_come_from_whole_batches(spark):
    df = spark.createDataFrame([(0, f"[{payload()},{payload(event_id='b')}]"), (1, f"[{payload()},{payload(sequence=0)}]")], "request_id int, body string")
    assert rows(admitted_events(df, ADMINISTRATOR).select("request_id", "pos", "event_id"), "pos") == [(0, 0, "e-0007"), (0, 1, "b")]


def test_oversized_bodies_fail_decode(spark):
    big = payload(event_id="x" * (1 << 20))
    df = spark.createDataFrame([(0, big), (1, payload())], "i int, body string")
    assert rows(admit_single(df, ADMINISTRATOR).select("i", "reason"), "i") == [(0, "decode_failed"), (1, None)]


def test_rejections(spark):
    df = spark.createDataFrame([
        (1, "decode_failed", "", None, "{broken"), (2, "validation_failed", "harbour", " ", '{"a":1}'),
        (3, "backpressure", "harbour", "s", "{}"), (4, "forbidden", None, None, "{}"), (5, None, None, None, "{}"),
    ], "id int, reason string, tenant_id string, source_id string, payload string")
    stored = to_rejections(df, F.col("payload"), F.lit(NOW), F.col("id"))
    assert rows(stored.select("id", "reason", "tenant_id", "source_id", "payload"), "id") == [
        ("1", "decode_failed", None, None, BAD_PAYLOAD), ("2", "validation_failed", "harbour", None, '{"a":1}')]
    assert rows(rejection_counts(df), "reason") == [("backpressure", 1), ("decode_failed", 1), ("validation_failed", 1)]
    recent = q.recent_rejections(stored, principal=OWNER)
    assert rows(recent.select("id", "tenant_id", "source_id")) == [("2", "harbour", "")]


def test_dead_letter_record(spark):
    msg = spark.createDataFrame([(b"k", b'{"schema_version":1', "t", 1, 42, NOW, [("h", b"v")])], LOG_MESSAGE).withColumnRenamed("timestamp", "log_time")
    letters = to_dead_letters(classify(msg), " group ", F.lit(NOW))
    r = letters.first()
    assert (r["reason"], r["source_partition"], r["source_offset"], r["source_key"], r["consumer_group"]) == ("decode_failed", 1, 42, "k", "group")
    assert r["payload_base64"] == "eyJzY2hlbWFfdmVyc2lvbiI6MQ==" and r["headers"][0]["value_base64"] == "dg=="
    out = dead_letter_log(letters).first()
    assert bytes(out["key"]) == b"k" and out["headers"][0]["key"] == "dead-letter-reason"
    assert b'"event_id"' not in bytes(out["value"])


def views(spark):
    shard = [(NOW, "harbour", 1, 4, 2, 1, 1, 10.0, NOW), (NOW, "harbour", 2, 2, 2, 0, 0, 2.0, NOW),
             (NOW - dt.timedelta(seconds=60), "tenant_2", 1, 6, 0, 0, 6, 1.0, NOW), (NOW - dt.timedelta(seconds=61), "tenant_2", 1, 9, 0, 0, 9, 1.0, NOW)]
    shards = spark.createDataFrame(shard, VIEWS["tenant_metric_shards"])
    legacy = spark.createDataFrame([(NOW, "harbour", 4, 4, 0, 0, 8.0, NOW)], VIEWS["tenant_metrics"])
    return shards, legacy


def test_legacy_and_shards_add_up(spark):
    shards, legacy = views(spark)
    series = q.tenant_series(shards, legacy, "harbour", F.lit(NOW))
    assert rows(series) == [(NOW, 10, 8, 1, 1, 2.0)]
    rates = q.overview_rates(shards, legacy, F.lit(NOW)).first()
    assert tuple(rates) == (16 / 60.0, 7 / 16)
    assert tuple(q.overview_rates(shards, None, F.lit(NOW + dt.timedelta(hours=1))).first()) == (0.0, 0.0)


def test_tenant_scope(spark):
    shards, _ = views(spark)
    assert scoped(shards, OWNER).count() == 2 and scoped(shards, ADMINISTRATOR).count() == 4 and scoped(shards, Principal(SERVICE)).count() == 4
    state = spark.createDataFrame([("s", "i", "{}", NOW)], VIEWS["service_state"])
    assert scoped(state, OWNER).count() == 0 and scoped(state, ADMINISTRATOR).count() == 1
    hidden = spark.createDataFrame([("1", "r", None, None, "{}", NOW)], VIEWS["rejection_events"])
    assert scoped(hidden, OWNER).count() == 0
    assert requested_tenant(OWNER, "") == "harbour"
    with pytest.raises(Forbidden):
        requested_tenant(OWNER, "tenant_2")
    with pytest.raises(ValueError):
        requested_tenant(ADMINISTRATOR, " ")
    with pytest.raises(Forbidden):
        q.partitions(state, F.lit(NOW), OWNER)
    with pytest.raises(ValueError):
        q.top_sources(spark.createDataFrame([], VIEWS["source_metrics"]), limit=0)


def test_windows_of_unknown_size_are_empty(spark):
    window = spark.createDataFrame([(60, NOW, "harbour", "s", 1, 1, 0, 0, 2.0, NOW)], VIEWS["event_windows"])
    assert q.event_windows(window, "harbour", F.lit(NOW), window_size="2m").count() == 0
    assert q.event_windows(window, "harbour", F.lit(NOW)).first()["window_size"] == "1m0s"
    with pytest.raises(ValueError):
        q.event_windows(window, "harbour", F.lit(NOW), lookback="0s")


def test_overview_for_a_tenant_user(spark):
    shards, legacy = views(spark)
    sources = spark.createDataFrame([("harbour", "s", 7, NOW), ("tenant_2", "s", 9, NOW)], VIEWS["source_metrics"])
    rejections = spark.createDataFrame([("1", "r", "harbour", None, "{}", NOW), ("2", "r", "tenant_2", None, "{}", NOW)], VIEWS["rejection_events"])
    state = spark.createDataFrame([("ingest-service", "i", '{"accepted_total":5}', NOW)], VIEWS["service_state"])
    mine = q.overview(shards, legacy, sources, rejections, state, F.lit(NOW), OWNER).first()
    assert (mine["accepted_total"], mine["processed_total"], mine["consumer_lag"], len(mine["recent_rejections"])) == (0, 7, 0, 1)
    assert mine["partition_health"] == [] and mine["window_sizes"] == ["1m0s", "5m0s"] and mine["allowed_lateness"] == "2m0s"
    every = q.overview(shards, legacy, sources, rejections, state, F.lit(NOW)).first()
    assert (every["accepted_total"], every["processed_total"], len(every["recent_rejections"])) == (5, 16, 2)


def test_evidence_files(spark, tmp_path):
    missing = read_evidence(spark, str(tmp_path / "none.json")).first()
    assert (missing["status"], missing["schema_version"], missing["failure_drills"], missing["benchmark"]) == ("missing", 1, [], None)
    (tmp_path / "r.json").write_text('﻿{"status":"","benchmark":{"target_eps":5000},"failure_drills":[{"scenario_id":"s"}]}', encoding="utf-8")
    r = read_evidence(spark, str(tmp_path / "r.json")).first()
    assert r["status"] == "available" and r["artifact_root"].endswith("r.json")
    assert r["benchmark"]["gaps"] == [] and r["benchmark"]["gates"] == [] and r["failure_drills"][0]["metrics"] == []
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        read_evidence(spark, str(tmp_path / "bad.json")).collect()


def test_report_files_and_samples(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "broker-outage-20260417-224838.json").write_text('{"archive_accounting_gap":0}')
    (folder / "inject-poison-message-20260417-193308.json").write_text("{}")
    files = read_report_files(spark, str(folder))
    assert [r["kind"] for r in files.orderBy("kind").collect()] == ["broker-outage", "inject-poison-message"]
    assert latest_per_key(files, "kind", "modified_at").count() == 2
    write_report(files.select("kind", F.struct("artifact").alias("inner")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    samples = spark.createDataFrame([("r", NOW, "m", {"stage": "s"}, 1.0)], "run_id string, sample_ts timestamp, metric string, labels map<string,string>, value double")
    samples.write.parquet(str(tmp_path / "samples"))
    assert read_samples(spark, str(tmp_path / "samples")).first()["labels"] == {"stage": "s"}
