import datetime as dt

import pytest
from helpers import BASE, DROP, payload
from pyspark.sql import functions as F

from tidemark.functions.text import encode_event, event_struct
from tidemark.operators.contracts import contract_violations, dead_letter_violations, report_violations
from tidemark.operators.decode import accepted, classify

CASES = [
    (payload(), None, None),
    ('{"schema_version":1', "decode_failed", "decode event: invalid JSON"),
    (payload(unknown="boom"), "decode_failed", 'decode event: unknown field "unknown"'),
    (payload(sequence=0), "validation_failed", "sequence must be greater than zero"),
    (payload(sequence=0, unknown=1), "validation_failed", "sequence must be greater than zero"),
    (payload(value="x"), "decode_failed", "decode event: field has the wrong type"),
    (payload(event_id=5), "decode_failed", "decode event: field has the wrong type"),
    (payload().replace("-3.25", "1e400"), "decode_failed", "decode event: field has the wrong type"),
    ("null", "validation_failed", "schema_version must be 1"),
    (payload(event_id=None), "validation_failed", "event_id is required"),
    (payload() + " trailing", None, None),
    (payload(sequence=0, unknown=1) + " trailing", "decode_failed", 'decode event: unknown field "unknown"'),
    (payload(timestamp="2026-04-11"), "decode_failed", "decode event: field has the wrong type"),
    (payload(timestamp="2026-02-30T00:00:00Z"), "decode_failed", "decode event: field has the wrong type"),
    (payload(timestamp="2026-04-11T13:00:00.5+02:00"), None, None),
    (payload(timestamp="0001-01-01T00:00:00Z"), "validation_failed", "timestamp is required"),
    (payload(timestamp=DROP), "validation_failed", "timestamp is required"),
    (payload(schema_version=99), "validation_failed", "schema_version must be 1"),
    (payload(schema_version=1.0), "decode_failed", "decode event: field has the wrong type"),
    (payload(tenant_id=" \t"), "validation_failed", "tenant_id is required"),
    (payload(source_id=""), "validation_failed", "source_id is required"),
    (payload(event_type="  "), "validation_failed", "event_type is required"),
    (payload(status="bad"), "validation_failed", "status must be one of ok, warn, error"),
    (payload(value=DROP, region=DROP), None, None),
    ("[1]", "decode_failed", "decode event: JSON object expected"),
    ("", "decode_failed", "decode event: invalid JSON"),
    # a repeated key keeps its last value
    (payload()[:-1] + ',"sequence":0}', "validation_failed", "sequence must be greater than zero"),
    # several broken rules: the first in order is reported
    (payload(status="bad", tenant_id=""), "validation_failed", "tenant_id is required"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, value string")
    got = {r["i"]: (r["reason"], r["error"]) for r in classify(df).select("i", "reason", "error").collect()}
    for i, (text, reason, error) in enumerate(CASES):
        assert got[i] == (reason, error), text


def test_ids_recovered_and_time_in_utc(spark):
    df = spark.createDataFrame([(payload(timestamp="2026-04-11T13:00:00.5+02:00"),), (payload(value="x"),),
                                ('{"schema_version":1',)], "value string")
    first, second, third = classify(df).collect()
    assert first["event"]["timestamp"] == dt.datetime(2026, 4, 11, 11, 0, 0, 500000)
    assert (second["event"]["event_id"], second["event"]["tenant_id"]) == ("e-0007", "harbour")
    assert third["event"]["event_id"] is None


def test_encode_round_trip_and_default_version(spark):
    df = spark.createDataFrame([(payload(),)], "value string")
    events = accepted(classify(df)).withColumn("schema_version", F.lit(0).cast("bigint"))
    text = events.select(encode_event(event_struct()).alias("value"))
    back = accepted(classify(text)).first().asDict()
    assert back == {**BASE, "timestamp": dt.datetime(2025, 8, 21, 6, 30, 15)}


def test_parse_happens_once_under_a_filter(spark):
    df = spark.createDataFrame([(payload(),)], "value string").where("length(value) > 0")
    plan = classify(df).where("reason IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") <= 4


@pytest.mark.parametrize("text,expected", [
    (payload(), []),
    (payload(event_type="other"), ["event_type: const"]),
    (payload(region=DROP), ["region: required"]),
    (payload(region=""), ["region: minLength"]),
    (payload(value=DROP), ["value: required"]),
    (payload(value="1"), ["value: type"]),
    (payload(sequence=0, extra=1), ["sequence: minimum", "additionalProperties"]),
    (payload(timestamp="yesterday"), ["timestamp: format"]),
    (payload(schema_version=2, status="x"), ["schema_version: const", "status: enum"]),
    ("[]", ["type: object"]),
    (payload() + " x", ["type: object"]),
])
def test_event_contract(spark, text, expected):
    df = spark.createDataFrame([(text,)], "value string")
    assert contract_violations(df).first()["violations"] == expected


def test_dead_letter_contract(spark):
    good = ('{"failed_at":"2026-04-10T12:00:00Z","reason":"decode_failed","error":"","source_topic":"t",'
            '"source_partition":1,"source_offset":42,"payload_base64":"eA=="%s}')
    cases = [
        (good % "", []),
        (good % ',"headers":[{"key":"a","value_base64":"eA=="}]', []),
        (good % ',"headers":[{"key":"","value_base64":"eA=="}]', ["headers: items"]),
        (good % ',"headers":[{"key":"a"}]', ["headers: items"]),
        (good % ',"other":1', ["additionalProperties"]),
        ((good % "").replace('"reason":"decode_failed"', '"reason":""'), ["reason: minLength"]),
        ((good % "").replace('"source_offset":42', '"source_offset":-1'), ["source_offset: minimum"]),
        ((good % "").replace('"eA=="', '"?"'), ["payload_base64: contentEncoding"]),
        ((good % "").replace('"error":"",', ""), ["error: required"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, value string")
    got = {r["i"]: r["violations"] for r in dead_letter_violations(df).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


REPORT = ('{"schema_version":1,"generated_at":"g","status":"available","artifact_root":"a","benchmark":%s,'
          '"failure_drills":[{"scenario_id":"s","title":"t","status":"x","artifact":"","started_at_utc":"",'
          '"completed_at_utc":"","result":"","operator_note":"","remaining_gap":"","metrics":[%s]}]}')
BENCH = ('{"artifact":"a","started_at_utc":"","completed_at_utc":"","summary":"","target_eps":1,"accepted_eps":1.5,'
         '"processed_eps":1,"query_p95_ms":1,"peak_lag":0,"post_load_drain_seconds":1,"producer_count":1,'
         '"processor_replicas":1,"batch_size":1,"gaps":["x"],"gates":[{"name":"g","status":"pass","target":1,"observed":2}]}')


@pytest.mark.parametrize("text,expected", [
    (REPORT % (BENCH, '{"label":"l","value":"1"}'), []),
    ("﻿" + REPORT % ("null", ""), []),
    (REPORT % (BENCH.replace('"target_eps":1', '"target_eps":"1"'), ""), ["benchmark.target_eps: number"]),
    (REPORT % (BENCH.replace('["x"]', "[1]"), ""), ["benchmark.gaps: items"]),
    (REPORT % (BENCH.replace('"observed":2', '"observed":"2"'), ""), ["benchmark.gates: items"]),
    (REPORT % ("null", '{"label":"l","value":1}'), ["failure_drills: items"]),
    (REPORT.replace('"schema_version":1', '"schema_version":2') % ("null", ""), ["schema_version: const"]),
    ('{"schema_version":1,"generated_at":"","status":"","artifact_root":""}', ["failure_drills: array"]),
])
def test_report_contract(spark, text, expected):
    df = spark.createDataFrame([(text,)], "value string")
    assert report_violations(df).first()["violations"] == expected
