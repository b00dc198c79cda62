import datetime as dt
import json
import math
import random

from helpers import rows
from pyspark.sql import functions as F

from tidemark.functions.timeparts import duration_label, duration_seconds, window_label
from tidemark.operators import alerts, counters, evidence, quantiles, runs, state
from tidemark.operators.aggregates import histogram

NOW = dt.datetime(2025, 8, 21, 6, 30)


def state_rows(spark, items):
    return spark.createDataFrame(
        [(s, i, json.dumps(p), u) for s, i, p, u in items], "service_name string, instance_id string, payload string, updated_at timestamp")


def test_ingest_totals(spark):
    seconds = [0, 4, 9, 15, 16, 400]  # the last two have not reported for more than 15 s
    items = [("ingest-service", f"gate-{i}", {"accepted_total": 11 * i + 2, "rejected_total": i}, NOW - dt.timedelta(seconds=s))
             for i, s in enumerate(seconds)]
    items.append(("stream-processor", "gate-0", {"accepted_total": 5000, "rejected_total": 5000}, NOW))
    live = state.live_states(state_rows(spark, items), state.INGEST, F.lit(NOW))
    assert rows(state.ingest_state(live)) == [(sum(11 * i + 2 for i in range(4)), 0 + 1 + 2 + 3, NOW)]


def test_processor_totals_and_health(spark):
    """Replicas with drawn numbers: sums, worst quantiles and each partition's last entry, as plain Python has them."""
    rng = random.Random(17)
    sums = ("processed_total", "duplicate_total", "dead_letter_total", "consumer_lag", "active_partitions", "inflight_messages")
    worst = ("processing_p50_ms", "processing_p95_ms", "processing_p99_ms")
    replicas = {}
    for name in ("east", "north", "west"):
        parts = [{"partition": p, "lag": rng.randrange(900), "processed_total": rng.randrange(50), "last_offset": rng.randrange(10**6)}
                 for p in rng.sample(range({"east": 0, "north": 10, "west": 20}[name], {"east": 10, "north": 20, "west": 30}[name]), 4)]
        parts.append({**parts[0], "lag": parts[0]["lag"] + 1000})  # a partition listed twice
        replicas[name] = {**{k: rng.randrange(10_000) for k in sums}, **{k: rng.randrange(1000) / 8 for k in worst}, "partitions": parts}
    items = [("stream-processor", name, body, NOW - dt.timedelta(seconds=3 * i)) for i, (name, body) in enumerate(replicas.items())]
    items.append(("stream-processor", "gone", replicas["east"], NOW - dt.timedelta(seconds=90)))
    live = state.live_states(state_rows(spark, items), state.PROCESSOR, F.lit(NOW))
    total = state.processor_state(live).first()
    assert {k: total[k] for k in sums} == {k: sum(r[k] for r in replicas.values()) for k in sums}
    assert {k: total[k] for k in worst} == {k: max(r[k] for r in replicas.values()) for k in worst}
    assert total["instance_count"] == 3
    last = {p["partition"]: (name, p["lag"]) for name, r in replicas.items() for p in r["partitions"]}
    health = state.partition_health(live).collect()
    assert {r["partition"]: (r["owner_instance_id"], r["lag"]) for r in health} == last


def test_no_instances_gives_zeros(spark):
    empty = state.live_states(state_rows(spark, [("x", "y", {}, NOW)]), state.INGEST, F.lit(NOW))
    assert rows(state.ingest_state(empty)) == [(0, 0, None)]


def test_freshness(spark):
    ages = [0, 15, 15.4, 16, 60, 61, None]
    df = spark.createDataFrame([(i, None if a is None else NOW - dt.timedelta(seconds=a)) for i, a in enumerate(ages)], "i int, t timestamp")
    got = [r[0] for r in df.orderBy("i").select(state.freshness_class(F.col("t"), F.lit(NOW))).collect()]
    assert got == ["healthy", "healthy", "healthy", "stale", "stale", "offline", "unknown"]


def test_status_and_percent(spark):
    row = spark.range(1).select(
        state.system_status(F.lit(50_001), F.lit(0.0)), state.system_status(F.lit(50_000), F.lit(0.05)),
        state.system_status(F.lit(0), F.lit(0.051)), state.processed_percent(F.lit(150), F.lit(100)),
        state.processed_percent(F.lit(1), F.lit(0))).first()
    assert tuple(row) == ("Pressure", "Nominal", "Pressure", 100.0, 0.0)


def test_quantile_rules_differ(spark):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate([40, 10, 30, 20])], "v double, o int")
    assert rows(quantiles.rolling_quantiles(df, [], ["o"], "v")) == [(4, 20.0, 30.0, 30.0)]
    assert rows(quantiles.nearest_rank(df, [], "v")) == [(4, 20.0, 40.0, 40.0)]
    # only the newest two values count
    assert rows(quantiles.rolling_quantiles(df, [], ["o"], "v", 2)) == [(2, 20.0, 20.0, 20.0)]


def test_nearest_rank_against_brute_force(spark):
    rng = random.Random(3)
    data = [(k, round(rng.choice([rng.uniform(-5, 5), rng.lognormvariate(3, 2), 7.0]), 2)) for k in "abc" for _ in range(rng.randint(1, 900))]
    got = {r[0]: tuple(r)[1:] for r in quantiles.nearest_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in "abc":
        vals = sorted(v for kk, v in data if kk == k)
        want = tuple(vals[max(math.ceil(p / 100.0 * len(vals)) - 1, 0)] for p in (50, 95, 99))
        assert got[k] == (len(vals), *want)


def samples(spark, values, step=60):
    return spark.createDataFrame([("s", NOW + dt.timedelta(seconds=step * i), float(v)) for i, v in enumerate(values)],
                                 "series string, sample_ts timestamp, value double")


def test_reset_aware_increase(spark):
    assert rows(counters.counter_increase(samples(spark, [5, 9, 2, 6]), ["series"])) == [("s", 10)]
    assert rows(counters.counter_increase(samples(spark, [5, 9, 2, 6]), ["series"], block=60_000_000)) == [("s", 10)]
    assert rows(counters.counter_increase(samples(spark, [5]), ["series"])) == [("s", 0)]


def brute_sustained(flags, due, step):
    out, start = [], None
    for i, on in enumerate(flags + [False]):
        if on and start is None:
            start = i
        if not on and start is not None:
            if (i - 1 - start) * step >= due:
                out.append((start, start + math.ceil(due / step), i - 1))
            start = None
    return out


def test_sustained_against_brute_force(spark):
    rng = random.Random(5)
    flags = [rng.random() < 0.8 for _ in range(400)]
    for block in (60_000_000, 600_000_000, 10**13):
        df = alerts.sustained(samples(spark, flags), F.col("value") > 0, 120, block=block)
        got = [tuple(int((t - NOW).total_seconds() // 60) for t in r) for r in df.orderBy("started_at").collect()]
        assert got == brute_sustained(flags, 120, 60)


def test_histogram_quantile(spark):
    inf = float("inf")
    df = spark.createDataFrame([("st", 0.1, 10.0), ("st", 0.5, 30.0), ("st", 1.0, 90.0), ("st", inf, 100.0), ("none", 0.1, 0.0), ("none", inf, 0.0)],
                               "stage string, le double, amount double")
    got = {r["stage"]: tuple(r)[1:] for r in counters.histogram_quantile(df, ["stage"]).collect()}
    # rank 50 lies in (0.5, 1.0]: 0.5 + 0.5 * 20 / 60; ranks 95 and 99 lie in the open bucket
    assert got["st"] == (666.67, 1000.0, 1000.0)
    assert got["none"] == (None, None, None)


def test_size_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (1, 3, 5, 600, 2000)], "size int")
    got = dict(rows(histogram(df, "size")))
    assert (got["1"], got["5"], got["500"], got["1000"], got["+Inf"]) == (1, 3, 3, 4, 5)


def test_run_helpers(spark):
    lag = spark.createDataFrame([("r", NOW + dt.timedelta(seconds=s), float(v)) for s, v in ((0, 5), (10, 900), (20, 50), (30, 5), (40, 1))],
                                "run_id string, sample_ts timestamp, value double")
    stops = spark.createDataFrame([("r", NOW + dt.timedelta(seconds=12), 5.0), ("q", NOW, 5.0)], "run_id string, stopped_at timestamp, target_lag double")
    assert rows(runs.drain_seconds(lag, stops), "run_id") == [("q", 60.0), ("r", 18.0)]
    marks = spark.createDataFrame([("r", NOW + dt.timedelta(seconds=12))], "run_id string, marked_at timestamp")
    assert rows(runs.recovery_by_lag(lag, marks)) == [("r", NOW + dt.timedelta(seconds=20), True, 8.0)]
    count = samples(spark, [5, 5, 5, 9], 10).withColumnRenamed("series", "run_id").withColumn("run_id", F.lit("r"))
    assert rows(runs.recovery_by_counter(count, marks)) == [("r", NOW + dt.timedelta(seconds=30), True, 18.0)]
    early = marks.withColumn("marked_at", F.col("marked_at") - F.expr("INTERVAL 1 HOUR"))
    # no sample before the marker: the final value is the baseline, so nothing exceeds it
    assert rows(runs.recovery_by_counter(count, early)) == [("r", None, False, None)]


def test_durations(spark):
    assert [duration_seconds(t, "15m") for t in (None, "1m30s", "1.5h", "250ms")] == [900, 90, 5400, 0.25]
    for bad in ("", "5", "m", "-1m", "0s", "1x"):
        if bad:
            try:
                duration_seconds(bad, "15m")
                raise AssertionError(bad)
            except ValueError:
                pass
    assert [duration_label(s) for s in (60, 300, 90061, 1, 0.25)] == ["1m0s", "5m0s", "25h1m1s", "1s", "250ms"]
    df = spark.createDataFrame([(60,), (300,), (90061,), (1,)], "s int")
    assert [r[0] for r in df.select(window_label("s")).collect()] == ["1m0s", "5m0s", "25h1m1s", "1s"]


def test_drills_and_evidence(spark):
    def report(**k):
        return json.dumps(k)

    files = spark.createDataFrame([
        ("restart-processor", "r1.json", NOW, report(lag_recovered_within_window=False)),
        ("restart-processor", "r2.json", NOW + dt.timedelta(hours=1), report(
            lag_recovered_within_window=True, recovery_seconds=6.29, accepted_total_delta=12000, processed_total_delta=8238,
            started_at_utc="2026-04-17T19:51:42.2420000Z")),
        ("broker-outage", "b.json", NOW, report(archive_accounting_gap=3, accepted_recovered_within_window=True)),
        ("inject-poison-message", "p.json", NOW, report(dead_letter_delta=1)),
        ("benchmark", "bench.json", NOW, report(rate_target_eps=5000, accepted_eps=4971.03, processed_eps=5101.71, query_latency_p95_ms=54.91,
                                                post_load_drain_seconds=2.05, producer_count=4, processor_replicas_observed=3, batch_size=25)),
    ], "kind string, artifact string, modified_at timestamp, payload string")
    row = evidence.evidence_summary(files, "artifacts", F.lit(NOW)).first()
    states = [(d["scenario_id"], d["status"]) for d in row["failure_drills"]]
    assert states == [("restart-processor", "verified"), ("broker-outage", "degraded"), ("pause-postgres", "missing"),
                      ("replay-archive", "missing"), ("poison-message", "verified")]
    first = row["failure_drills"][0]
    assert first["result"] == "Lag recovered in 6.29 seconds." and first["artifact"] == "r2.json"
    assert first["started_at_utc"] == "2026-04-17T19:51:42.2420000Z"
    assert [m["value"] for m in first["metrics"]] == ["12,000", "8,238", "0", "0"]
    bench = row["benchmark"]
    assert bench["summary"].startswith("Accepted 4,971.0 eps and processed 5,101.7 eps against a 5,000 eps target using 4 producer(s)")
    assert bench["gaps"] == [evidence.GAP_NONE]
    assert [g["status"] for g in bench["gates"]] == ["pass"] * 4
