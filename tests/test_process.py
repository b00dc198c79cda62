import datetime as dt
import random

from helpers import rows, unordered
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.functions.measures import shard_id
from tidemark.operators import aggregates as agg
from tidemark.operators.dispositions import disposition_counts
from tidemark.operators.lateness import mark_late
from tidemark.operators.scans import previous_value, running_max, trailing_sum
from tidemark.plans.process import process_batch

T0 = dt.datetime(2026, 4, 10, 10, 0)
SCHEMA = ("topic string, partition int, offset bigint, log_time timestamp, event_id string, tenant_id string, "
          "source_id string, timestamp timestamp, value double, status string")


def log(spark, items):
    """``items``: (offset, event id, minutes after ten o'clock)."""
    data = [("t", 0, o, T0 + dt.timedelta(seconds=o), e, "tenant_1", "s", T0 + dt.timedelta(minutes=m), 1.0, "ok")
            for o, e, m in items]
    return spark.createDataFrame(data, SCHEMA)


def test_late_against_partition_mark(spark):
    marked = mark_late(log(spark, [(0, "a", 0), (1, "b", 3), (2, "c", 0.5)]))
    assert [r["late"] for r in marked.orderBy("offset").collect()] == [False, False, True]


def test_exactly_at_the_allowance_is_on_time(spark):
    marked = mark_late(log(spark, [(0, "a", 2), (1, "b", 0)]))
    assert [r["late"] for r in marked.orderBy("offset").collect()] == [False, False]


def test_carried_marks(spark):
    marks = spark.createDataFrame([("t", 0, T0 + dt.timedelta(minutes=10))], "topic string, partition int, max_event_time timestamp")
    marked = mark_late(log(spark, [(0, "a", 7.9), (1, "b", 8)]), marks=marks)
    assert [r["late"] for r in marked.orderBy("offset").collect()] == [True, False]


def test_late_duplicate_counts_as_duplicate_and_duplicates_raise_the_mark(spark):
    p = process_batch(log(spark, [(0, "a", 0), (1, "b", 5), (2, "a", 0), (3, "c", 1), (4, "c", 9), (5, "d", 5)]))
    # c: first copy is late; its second copy is a duplicate that still raises the mark to 9
    assert rows(disposition_counts(p.progress), "disposition") == [("duplicate", 2), ("late", 2), ("recorded", 2)]
    assert sorted(r["event_id"] for r in p.late.collect()) == ["c", "d"]


def test_fixture_dispositions(spark, sf):
    counts = dict(rows(disposition_counts(fx.processed(spark, sf).progress)))
    assert counts == {"recorded": 983, "duplicate": 77, "late": 17}


def test_blocked_scans_equal_plain_windows(spark):
    rng = random.Random(7)
    data = [(rng.choice("ab"), i, T0 + dt.timedelta(seconds=i), rng.choice([None, rng.randint(0, 10**6)])) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, o bigint, ts timestamp, v bigint")
    whole = Window.partitionBy("k").orderBy("o")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    for block in (1, 7, 1000, 10**6):
        got = running_max(df, ["k"], "o", F.col("v"), "m", block).select("k", "o", "m")
        assert unordered(got) == unordered(df.select("k", "o", F.max("v").over(upto).alias("m")))
        got = previous_value(df, ["k"], "o", "v", "p", block).select("k", "o", "p")
        assert unordered(got) == unordered(df.select("k", "o", F.lag("v").over(whole).alias("p")))
    span = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-59_999_999, 0)
    want = df.select("k", "o", F.sum("v").over(span).alias("s"))
    for block in (60, 100, 3600):
        got = trailing_sum(df, ["k"], "ts", "v", 60, "s", block).select("k", "o", "s")
        assert unordered(got) == unordered(want)


def test_shard_value_and_spread(spark):
    one = spark.createDataFrame([("tenant_01", "sensor_001")], "tenant_id string, source_id string")
    assert one.select(shard_id()).first()[0] == 5
    many = spark.range(200).select(F.lit("tenant_1").alias("tenant_id"), F.format_string("sensor_%03d", "id").alias("source_id"))
    ids = [r[0] for r in many.select(shard_id()).collect()]
    assert set(ids) <= set(range(32)) and len(set(ids)) >= 16

    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h % 32

    odd = spark.createDataFrame([("é日", "ß"), ("", "x"), ("😀", "")], "tenant_id string, source_id string")
    for r in odd.withColumn("s", shard_id()).collect():
        assert r["s"] == fnv(r["tenant_id"] + "\0" + r["source_id"])


def test_windows_equal_direct_aggregation(spark, sf):
    recorded = fx.processed(spark, sf).recorded
    nested = agg.event_windows(agg.base_grain(recorded), [60, 300]).drop("value_sum")
    direct = None
    for size in (60, 300):
        part = recorded.groupBy(
            F.lit(size).alias("window_size_seconds"), F.window("timestamp", f"{size} seconds").start.alias("window_start"),
            "tenant_id", "source_id",
        ).agg(
            F.count("*").alias("events_count"), F.count_if(F.col("status") == "ok").alias("ok_count"),
            F.count_if(F.col("status") == "warn").alias("warn_count"), F.count_if(F.col("status") == "error").alias("error_count"),
            F.max("timestamp").alias("max_event_at"))
        direct = part if direct is None else direct.unionByName(part)
    assert unordered(nested) == unordered(direct)


def test_repeated_id_is_cut_before_the_shuffle(spark):
    plan = process_batch(log(spark, [(0, "a", 0)])).winners._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_hot_id_and_hot_source(spark):
    """A third of all rows repeat one id and half come from one source; nothing is lost."""
    rng = random.Random(2)
    data, at = [], {}
    for i in range(6000):
        eid = "hot" if rng.random() < 0.34 else f"e{rng.randrange(3000)}"
        part = rng.randrange(2)
        at[part] = at.get(part, -1) + 1
        t = T0 + dt.timedelta(seconds=i + rng.choice([0, 0, 0, -200, 50]))
        data.append(("t", part, at[part], T0 + dt.timedelta(seconds=i), eid, "tenant_1", "s" if rng.random() < 0.5 else f"s{i % 7}", t, 0.1, "ok"))
    got = process_batch(spark.createDataFrame(data, SCHEMA), block=100)
    seen, marks, counts, sources = set(), {}, {"recorded": 0, "duplicate": 0, "late": 0}, {}
    for row in data:
        marks[row[1]] = max(marks.get(row[1], row[7]), row[7])
        late = row[7] < marks[row[1]] - dt.timedelta(seconds=120)
        kind = "duplicate" if row[4] in seen else "late" if late else "recorded"
        seen.add(row[4])
        counts[kind] += 1
        if kind == "recorded":
            sources[row[6]] = sources.get(row[6], 0) + 1
    assert dict(rows(disposition_counts(got.progress))) == counts
    assert {r["source_id"]: r["events_count"] for r in agg.source_metrics(got.grain).collect()} == sources
