"""DuckDB statements with the results the registered queries must have.

Each restates a query from the raw tables alone: plain windows over whole keys, no
blocks, shards of work or partial merges.
"""

from __future__ import annotations

from tidemark.operators import evidence
from tidemark.workload import REPORT_SPOILS, SOURCE, TENANT, _DRILLS

ORACLE: dict[str, str] = {}


def _shown(value: str) -> str:
    """Nine significant digits."""
    return f"CAST(printf('%.8e', {value}) AS DOUBLE)"


_E = 1704067200000000
_CUT = 1704088800000000

_KIND = "CASE " + " ".join(f"WHEN h IN {hours} THEN '{name}'" for name, hours in _DRILLS.items()) + " ELSE 'benchmark' END"
_SCENARIO_ROWS = ", ".join(
    f"({i}, '{sid}', '{title}', '{prefix.rstrip('-')}', '{note}', '{good}', '{bad}')"
    for i, (sid, title, prefix, note, good, bad) in enumerate(evidence.SCENARIOS)
)

# name -> (text, names it needs)
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tele": (f"""
SELECT 1 AS schema_version, 'evt-' || event_id AS event_id,
  'tenant_' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS tenant_id,
  'sensor_' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS source_id,
  ts_us, value, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'ok' END AS status,
  CASE event_id % 3 WHEN 0 THEN 'us-east' WHEN 1 THEN 'eu-west' ELSE 'ap-south' END AS region,
  event_id + 1 AS sequence, CAST(user_id % 12 AS INTEGER) AS part, arr_us, event_id AS n, copy_no,
  ((arr_us - {_E}) * 67108864) + (event_id & 33554431) * 2 + copy_no AS off
FROM (
  SELECT *, ts_us + CASE WHEN event_id % 11 = 0 THEN 300000000 WHEN event_id % 7 = 0 THEN 60000000 ELSE 0 END
    + copy_no * 10000000 AS arr_us
  FROM (SELECT event_id, user_id, event_type, value,
          {_E} + CAST(floor((epoch_us(ts) - {_E}) / 60) AS BIGINT) AS ts_us,
          unnest(CASE WHEN event_id % 13 = 0 THEN [0, 1] ELSE [0] END) AS copy_no
        FROM events))""", ()),
    "cls": ("""
SELECT *, CASE WHEN rn > 1 THEN 'duplicate' WHEN max_us - 120000000 > ts_us THEN 'late' ELSE 'recorded' END AS disposition
FROM (SELECT *, max(ts_us) OVER (PARTITION BY part ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_us,
        row_number() OVER (PARTITION BY event_id ORDER BY arr_us, part, off) AS rn FROM tele)""", ("tele",)),
    "rec": ("SELECT * FROM cls WHERE disposition = 'recorded'", ("cls",)),
    "now": ("SELECT max(ts_us) AS us FROM tele", ("tele",)),
    "win": ("""
SELECT size, ts_us - ts_us % (size * 1000000) AS w_us, tenant_id, source_id, count(*) AS n,
  count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'error') AS err,
  sum(value) AS vs, max(ts_us) AS last_us
FROM rec, (SELECT unnest([60, 300]) AS size) GROUP BY 1, 2, 3, 4""", ("rec",)),
    "src": ("SELECT tenant_id, source_id, count(*) AS events_count, make_timestamp(max(ts_us)) AS last_event_at FROM rec GROUP BY 1, 2",
            ("rec",)),
    # spoiled events and their texts
    "spoiled": ("""
SELECT n, arr_us, ts_us, part, off, value, event_id, region, CASE WHEN n % 29 = 0 THEN 99 ELSE 1 END AS schema_version,
  CASE WHEN n % 17 = 0 THEN '  ' ELSE tenant_id END AS tenant_id, CASE WHEN n % 31 = 0 THEN '' ELSE source_id END AS source_id,
  CASE WHEN n % 19 = 0 THEN 'bad' ELSE status END AS status, CASE WHEN n % 23 = 0 THEN 0 ELSE sequence END AS sequence,
  n % 41 = 0 AS extra, n % 43 = 0 AS texty
FROM tele WHERE copy_no = 0""", ("tele",)),
    "texts": ("""
SELECT *, '{"schema_version":' || schema_version || ',"event_id":"' || event_id || '","tenant_id":"' || tenant_id
  || '","source_id":"' || source_id || '","event_type":"telemetry","timestamp":"'
  || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z","value":'
  || CASE WHEN texty THEN '"x"' ELSE CAST(value AS VARCHAR) END || ',"status":"' || status || '","region":"' || region
  || '","sequence":' || sequence || CASE WHEN extra THEN ',"extra":"boom"}' ELSE '}' END AS text,
  CASE WHEN schema_version <> 1 THEN 'schema_version must be 1' WHEN trim(tenant_id) = '' THEN 'tenant_id is required'
    WHEN trim(source_id) = '' THEN 'source_id is required' WHEN status = 'bad' THEN 'status must be one of ok, warn, error'
    WHEN sequence <= 0 THEN 'sequence must be greater than zero' END AS invalid
FROM spoiled""", ("spoiled",)),
    "raw": ("""
SELECT *, n % 37 = 0 AS cut, n % 47 = 0 AS tail,
  CASE WHEN n % 37 = 0 THEN substr(text, 1, 20) WHEN n % 47 = 0 THEN text || ' tail' ELSE text END AS body
FROM texts""", ("texts",)),
    "judged": ("""
SELECT *, CASE WHEN cut THEN 'decode_failed' WHEN NOT extra AND NOT texty THEN CASE WHEN invalid IS NOT NULL THEN 'validation_failed' END
    WHEN NOT texty AND NOT tail AND invalid IS NOT NULL THEN 'validation_failed' ELSE 'decode_failed' END AS reason,
  CASE WHEN cut THEN 'decode event: invalid JSON' WHEN NOT extra AND NOT texty THEN invalid
    WHEN NOT texty AND NOT tail AND invalid IS NOT NULL THEN invalid
    WHEN extra THEN 'decode event: unknown field "extra"' ELSE 'decode event: field has the wrong type' END AS error
FROM raw""", ("raw",)),
    # batch requests of four events
    "elements": ("""
SELECT n // 4 AS request_id, n % 4 AS pos, *, CASE WHEN extra OR texty THEN 'decode_failed' WHEN invalid IS NOT NULL THEN 'validation_failed' END AS reason
FROM texts""", ("texts",)),
    "verdicts": ("""
SELECT e.request_id, e.events, e.received_us, f.reason, f.pos,
  CASE WHEN f.reason = 'validation_failed' THEN f.tenant_id END AS tenant_id, CASE WHEN f.reason = 'validation_failed' THEN f.source_id END AS source_id, f.text
FROM (SELECT request_id, count(*) AS events, max(arr_us) AS received_us, min(CASE WHEN reason IS NOT NULL THEN pos END) AS bad FROM elements GROUP BY 1) e
LEFT JOIN elements f ON f.request_id = e.request_id AND f.pos = e.bad""", ("elements",)),
    "rejected": ("""
SELECT CAST(request_id AS VARCHAR) AS id, reason, nullif(trim(tenant_id), '') AS tenant_id, nullif(trim(source_id), '') AS source_id,
  make_timestamp(received_us) AS created_at FROM verdicts WHERE reason IS NOT NULL""", ("verdicts",)),
    # states and samples
    "parts": ("""
SELECT part, 'proc-' || (part % 3) AS instance_id, count(*) FILTER (disposition = 'recorded') AS processed_total,
  count(*) FILTER (disposition = 'duplicate') AS duplicate_total, count(*) FILTER (disposition = 'late') AS late_event_total,
  max(off) AS last_offset, max(arr_us) AS seen_us, min(value) AS lo, max(value) AS hi FROM cls GROUP BY 1, 2""", ("cls",)),
    "live": ("""
SELECT *, max(seen_us) OVER (PARTITION BY instance_id) AS up_us FROM parts
QUALIFY max(seen_us) OVER (PARTITION BY instance_id) >= max(seen_us) OVER () - 15000000""", ("parts",)),
    "mins": ("""
SELECT arr_us - arr_us % 60000000 AS m_us, 'proc-' || (part % 3) AS instance_id, count(*) AS arrived, max(value) AS peak,
  count(*) FILTER (disposition = 'recorded') AS recorded, count(*) FILTER (disposition = 'late') AS late,
  count(*) FILTER (disposition = 'duplicate') AS duplicate FROM cls GROUP BY 1, 2""", ("cls",)),
    "counter": (f"""
SELECT instance_id, m_us, sum(recorded) OVER (PARTITION BY instance_id, m_us < {_CUT} ORDER BY m_us) AS v FROM mins""", ("mins",)),
    "grown": ("""
SELECT instance_id, m_us, CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END AS inc
FROM (SELECT *, lag(v) OVER (PARTITION BY instance_id ORDER BY m_us) AS p FROM counter)""", ("counter",)),
    "runm": ("""
SELECT 'run-' || strftime(make_timestamp(m_us), '%H') AS run_id, m_us, sum(arrived) AS arrived, sum(recorded) AS recorded,
  sum(late) AS late, sum(duplicate) AS duplicate, max(peak) AS peak FROM mins GROUP BY 1, 2""", ("mins",)),
    "runs": ("""
SELECT run_id, m_us, peak, late + duplicate AS lag, sum(arrived) OVER w AS archived, sum(recorded) OVER w AS processed,
  sum(duplicate) OVER w AS dup, sum(late) OVER w AS rej, CAST(sum(arrived - late) OVER w AS BIGINT) AS accepted0
FROM runm WINDOW w AS (PARTITION BY run_id ORDER BY m_us)""", ("runm",)),
    "deltas": ("""
SELECT run_id, min(m_us) AS a_us, max(m_us) AS b_us, (max(m_us) - min(m_us)) / 1e6 AS secs,
  CAST(max(archived) - min(archived) AS BIGINT) AS archived, CAST(max(processed) - min(processed) AS BIGINT) AS processed,
  CAST(max(dup) - min(dup) AS BIGINT) AS dup, CAST(max(rej) - min(rej) AS BIGINT) AS rej,
  CAST(max(lag) AS BIGINT) AS lag, max(peak) AS peak FROM runs GROUP BY 1""", ("runs",)),
    "markers": ("SELECT run_id, min(m_us) + 1800000000 AS at_us, arg_min(lag, m_us) AS target FROM runs GROUP BY 1", ("runs",)),
    "recent": ("SELECT status FROM rec WHERE ts_us - ts_us % 10000000 >= (SELECT max(arr_us) FROM tele) - 60000000", ("rec",)),
    "ing": ("""
SELECT a, r FROM (SELECT count(*) FILTER (status <> 'error') AS a, count(*) FILTER (status = 'error') AS r, max(arr_us) AS u FROM tele GROUP BY region)
WHERE u >= (SELECT max(arr_us) FROM tele) - 15000000""", ("tele",)),
    "spans": ("""
SELECT stage, le, c, lag(le, 1, 0.0) OVER w AS lo, lag(c, 1, 0) OVER w AS before, max(c) OVER (PARTITION BY stage) AS total FROM (
  SELECT stage, le, count(*) FILTER (m > f AND value <= le) AS c FROM (
    SELECT status AS stage, value, arr_us // 60000000 AS m, min(arr_us // 60000000) OVER (PARTITION BY part % 3, status) AS f FROM tele
    WHERE arr_us // 60000000 > (SELECT max(arr_us) // 60000000 FROM tele) - 120),
  (SELECT unnest([1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) GROUP BY 1, 2)
WINDOW w AS (PARTITION BY stage ORDER BY le)""", ("tele",)),
    "files": (f"""
SELECT *, {_KIND} AS kind FROM (SELECT *, CAST(substr(run_id, 5, 2) AS INTEGER) AS h, processed % 2 = 0 AS even FROM deltas)
QUALIFY row_number() OVER (PARTITION BY {_KIND} ORDER BY b_us DESC, run_id DESC) = 1""", ("deltas",)),
    "drills": (f"""
SELECT s.position, s.scenario_id, s.title, CASE WHEN f.kind IS NULL THEN 'missing' WHEN f.even OR f.kind = 'broker-outage' THEN 'verified' ELSE 'degraded' END AS status,
  coalesce(run_id || '.json', '') AS artifact, coalesce(strftime(make_timestamp(a_us), '%Y-%m-%dT%H:%M:%S.%f') || '0Z', '') AS started_at_utc,
  coalesce(strftime(make_timestamp(b_us), '%Y-%m-%dT%H:%M:%S.%f') || '0Z', '') AS completed_at_utc,
  CASE f.kind
    WHEN 'restart-processor' THEN CASE WHEN even THEN 'Lag recovered in ' || h || ' seconds.' ELSE 'Processor restarted, but lag did not drain inside the observation window.' END
    WHEN 'broker-outage' THEN 'Archive accounting gap 0; accepted traffic recovered: True.'
    WHEN 'pause-postgres' THEN CASE WHEN even THEN 'Processor progress recovered in ' || h || '.25 seconds after Postgres became ready.' ELSE 'Processor progress did not recover inside the observation window.' END
    WHEN 'replay-archive' THEN 'Duplicate-safe: True; rebuild restored: ' || CASE WHEN even THEN 'True.' ELSE 'False.' END
    ELSE '{evidence.MISSING[0]}' END AS result,
  CASE WHEN f.kind IS NULL THEN '{evidence.MISSING[1]}' ELSE s.note END AS operator_note,
  CASE WHEN f.kind IS NULL THEN '{evidence.MISSING[2]}' WHEN f.even OR f.kind = 'broker-outage' THEN s.good ELSE s.bad END AS remaining_gap,
  CASE f.kind
    WHEN 'restart-processor' THEN 'accepted delta=' || format('{{:,}}', archived - rej) || ';processed delta=' || format('{{:,}}', processed) || ';peak lag=' || format('{{:,}}', lag) || ';final lag=0'
    WHEN 'broker-outage' THEN 'accepted delta=' || format('{{:,}}', archived - rej) || ';publish failed=' || format('{{:,}}', rej) || ';backpressure=0;peak lag=' || format('{{:,}}', lag)
    WHEN 'pause-postgres' THEN 'processed delta=' || format('{{:,}}', processed) || ';overview failures=0;peak API latency=0.00;final lag=0'
    WHEN 'replay-archive' THEN 'replayed duplicates=0;duplicate delta=0;overcount delta=0;rebuild replayed=0' ELSE '' END AS metrics
FROM (VALUES {_SCENARIO_ROWS}) AS s(position, scenario_id, title, kind, note, good, bad) LEFT JOIN files f ON f.kind = s.kind""", ("files",)),
    "reports": ("""
SELECT run_id, 5000.0::DOUBLE AS target_eps, ((archived - rej) * (h + 1))::DOUBLE AS accepted_eps, (processed * (h + 1))::DOUBLE AS processed_eps,
  peak AS query_p95_ms, lag * (h + 1) * 1000 AS peak_lag, (h * 5)::DOUBLE AS drain
FROM (SELECT *, CAST(substr(run_id, 5, 2) AS INTEGER) AS h FROM deltas)""", ("deltas",)),
}


def _with(body: str, *names: str) -> str:
    """Prefix the CTEs a statement needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _CTES[name][1]:
            add(dep)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n][0]})" for n in order) + "\n" + body


def _sustained(ticks: str, pred: str, due_us: int, label: str = "") -> str:
    """Gaps and islands over ``(t, ...)`` rows."""
    return f"""
SELECT make_timestamp(s) AS started_at, make_timestamp(f) AS fired_at, make_timestamp(e) AS ended_at{label} FROM (
  SELECT s, min(t) FILTER (t - s >= {due_us}) AS f, max(t) AS e FROM (
    SELECT t, min(t) OVER (PARTITION BY off) AS s FROM (
      SELECT t, ({pred}) AS on_, max(CASE WHEN NOT ({pred}) THEN t END) OVER (ORDER BY t) AS off FROM ({ticks}))
    WHERE on_) GROUP BY s HAVING max(t) - s >= {due_us})"""


_MEAS = f"""count(*) AS events_count, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status = 'warn') AS warn_count,
  count(*) FILTER (status = 'error') AS error_count, {_shown("sum(value)")} AS value_sum"""
_WIN = """make_timestamp(w_us) AS window_start, CASE size WHEN 60 THEN '1m0s' ELSE '5m0s' END AS window_size, tenant_id, {src} AS source_id,
  {agg}, make_timestamp({last}) AS max_event_at, ((SELECT us FROM now) - {last}) / 1000.0 AS freshness_ms"""
_WIN_ALL = _WIN.format(src="''", last="max(last_us)", agg="""CAST(sum(n) AS BIGINT) AS events_count, CAST(sum(ok) AS BIGINT) AS ok_count,
  CAST(sum(warn) AS BIGINT) AS warn_count, CAST(sum(err) AS BIGINT) AS error_count, """ + _shown("sum(vs) / sum(n)") + " AS average_value")
_WIN_ONE = _WIN.format(src="source_id", last="last_us", agg="""n AS events_count, ok AS ok_count, warn AS warn_count, err AS error_count, """ + _shown("vs / n") + " AS average_value")
_HASH = """list_reduce(list_prepend(2166136261::BIGINT,
  list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || substr(hex(b), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295)"""
_FNV = f"CAST({_HASH} % 32 AS INTEGER)"
_KEYED = f"""(SELECT source_id AS sid, k, CAST(abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 12) AS INTEGER) AS p FROM (
  SELECT source_id, k, {_HASH} AS h FROM (SELECT DISTINCT source_id, tenant_id || ':' || source_id AS k, encode(tenant_id || ':' || source_id) AS b FROM tele)))"""

ORACLE.update({
    "dedup_claims": _with("SELECT event_id, tenant_id, part AS partition, off AS \"offset\", make_timestamp(arr_us) AS claimed_at FROM cls WHERE rn = 1", "cls"),
    "duplicate_rows": _with("SELECT event_id, part AS partition, off AS \"offset\" FROM cls WHERE rn > 1", "cls"),
    "late_events": _with("SELECT event_id, tenant_id, source_id, make_timestamp(ts_us) AS timestamp, make_timestamp(max_us) AS max_event_time FROM cls WHERE disposition = 'late'", "cls"),
    "disposition_totals": _with("SELECT disposition, count(*) AS row_count FROM cls GROUP BY 1", "cls"),
    "partition_progress": _with("SELECT part AS partition, processed_total, duplicate_total, late_event_total, last_offset, make_timestamp(seen_us) AS last_seen_at FROM parts", "parts"),
    "tenant_shards": _with(f"""SELECT make_timestamp(ts_us - ts_us % 10000000) AS bucket_start, tenant_id, shard_id, {_MEAS}, make_timestamp(max(ts_us)) AS last_event_at
FROM rec JOIN (SELECT source_id AS sid, {_FNV} AS shard_id FROM (SELECT DISTINCT source_id, encode(tenant_id || chr(0) || source_id) AS b FROM tele)) ON sid = source_id
GROUP BY 1, 2, 3""", "rec"),
    "tenant_rollup": _with(f"SELECT make_timestamp(ts_us - ts_us % 10000000) AS bucket_start, tenant_id, {_MEAS}, make_timestamp(max(ts_us)) AS last_event_at FROM rec GROUP BY 1, 2", "rec"),
    "source_metrics": _with("SELECT * FROM src", "src"),
    "rebuilt_sources": _with("SELECT * FROM src", "src"),
    "event_windows": _with("""SELECT size AS window_size_seconds, make_timestamp(w_us) AS window_start, tenant_id, source_id, n AS events_count, ok AS ok_count,
  warn AS warn_count, err AS error_count, """ + _shown("vs") + """ AS value_sum, make_timestamp(last_us) AS max_event_at FROM win""", "win"),
    "extreme_windows": _with(f"""SELECT size AS window_size_seconds, make_timestamp(ts_us - ts_us % (size * 1000000)) AS window_start, tenant_id, source_id,
  {_shown("sum(value * unit)")} AS value_sum
FROM (SELECT *, [1e-9::DOUBLE, 1.0::DOUBLE, 1e10::DOUBLE][CAST(substr(source_id, 8, 6) AS INTEGER) % 3 + 1] AS unit FROM rec),
  (SELECT unnest([60, 300]) AS size) GROUP BY 1, 2, 3, 4""", "rec"),
    "restarted_views": _with("SELECT * FROM src", "src"),
    "rebuilt_views": _with("SELECT * FROM src", "src"),
    "reset_totals": _with(f"""SELECT count(*) FILTER (rn = 1) AS processed_events, count(*) FILTER (disposition = 'recorded') AS source_events
FROM cls WHERE tenant_id <> '{TENANT}'""", "cls"),
    "replay_outcome": "SELECT 0::BIGINT AS source_metric_overcount_delta, 0::BIGINT AS processed_events_delta, count(*) > 0 AS duplicate_safe FROM events",
    "zero_time_partitions": _with("""SELECT CAST(make_timestamp(t) AS DATE) AS day, tenant_id AS tenant, strftime(make_timestamp(t), '%H') AS hour, count(*) AS line_count
FROM (SELECT tenant_id, CASE WHEN n % 5 = 0 THEN arr_us ELSE ts_us END AS t FROM tele) GROUP BY 1, 2, 3""", "tele"),
    "partition_lag": _with(f"""SELECT part AS partition, count(*) FILTER (disposition = 'recorded') AS processed_total, max(off) AS last_offset,
  any_value(end_off) - max(off) AS lag, any_value(end_off) - max(off) AS inflight_messages
FROM cls JOIN (SELECT part, max(off) AS end_off FROM tele GROUP BY part) USING (part) WHERE arr_us < {_CUT} GROUP BY part""", "cls"),
    "archive_scan": _with(f"""SELECT event_id, source_id, make_timestamp(ts_us) AS timestamp, make_timestamp(arr_us) AS archived_at
FROM tele WHERE tenant_id = '{TENANT}'""", "tele"),
    "event_windows_all_tenants": _with(f"SELECT {_WIN_ALL} FROM win WHERE size = 300 GROUP BY size, w_us, tenant_id", "win", "now"),
    "rebuilt_windows": _with(f"SELECT {_WIN_ALL} FROM win WHERE size = 300 GROUP BY size, w_us, tenant_id", "win", "now"),
    "shard_ids": _with(f"SELECT tenant_id, source_id, {_FNV} AS shard_id FROM (SELECT DISTINCT tenant_id, source_id, encode(tenant_id || chr(0) || source_id) AS b FROM tele)", "tele"),
    "size_histogram": _with("""SELECT le, CAST(CASE le WHEN '+Inf' THEN count(*) ELSE count(*) FILTER (size <= TRY_CAST(le AS BIGINT)) END AS BIGINT) AS bucket_count
FROM (SELECT count(*) AS size FROM tele GROUP BY part, arr_us // 60000000), (SELECT unnest(['1','5','10','25','50','100','250','500','1000','+Inf']) AS le) GROUP BY le""", "tele"),
    "overview_rates": _with("""SELECT count(*) / 60.0 AS events_per_second_last_minute, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (status = 'error') / count(*) END AS error_rate_last_minute
FROM rec WHERE ts_us - ts_us % 10000000 >= (SELECT us FROM now) - 60000000""", "rec", "now"),
    "processed_total": _with("SELECT count(*) AS stored_processed_total FROM rec", "rec"),
    "tenant_series": _with(f"""SELECT make_timestamp(ts_us - ts_us % 10000000) AS bucket_start, count(*) AS events_count, count(*) FILTER (status = 'ok') AS ok_count,
  count(*) FILTER (status = 'warn') AS warn_count, count(*) FILTER (status = 'error') AS error_count, {_shown("sum(value) / count(*)")} AS average_value
FROM rec WHERE tenant_id = '{TENANT}' AND ts_us - ts_us % 10000000 >= (SELECT us FROM now) - 43200000000 GROUP BY 1""", "rec", "now"),
    "event_windows_tenant": _with(f"SELECT {_WIN_ALL} FROM win WHERE size = 300 AND tenant_id = '{TENANT}' AND w_us >= (SELECT us FROM now) - 43200000000 GROUP BY size, w_us, tenant_id", "win", "now"),
    "event_windows_source": _with(f"SELECT {_WIN_ONE} FROM win WHERE size = 60 AND tenant_id = '{TENANT}' AND source_id = '{SOURCE}' AND w_us >= (SELECT us FROM now) - 43200000000", "win", "now"),
    "top_sources": _with("SELECT tenant_id, source_id, events_count AS events, last_event_at FROM src ORDER BY events DESC, last_event_at DESC, tenant_id, source_id LIMIT 10", "src"),
    "top_sources_tenant": _with(f"SELECT tenant_id, source_id, events_count AS events, last_event_at FROM src WHERE tenant_id = '{TENANT}' ORDER BY events DESC, last_event_at DESC, tenant_id, source_id LIMIT 5", "src"),
    "tenant_scope_view": _with(f"SELECT * FROM src WHERE tenant_id = '{TENANT}'", "src"),
    "overview": _with("""SELECT make_timestamp((SELECT max(arr_us) FROM tele)) AS generated_at,
  (SELECT count(*) FROM recent) / 60.0 AS events_per_second_last_minute,
  coalesce((SELECT count(*) FILTER (status = 'error') / nullif(count(*), 0) FROM recent), 0.0) AS error_rate_last_minute,
  (SELECT count(*) FROM rec) AS processed_total, (SELECT count(*) FROM rec) AS stored_processed_total,
  coalesce((SELECT sum(a) FROM ing), 0)::BIGINT AS accepted_total, coalesce((SELECT sum(r) FROM ing), 0)::BIGINT AS rejected_total,
  sum(processed_total)::BIGINT AS processor_processed_total, sum(duplicate_total)::BIGINT AS duplicate_total, sum(late_event_total)::BIGINT AS late_event_total,
  sum(duplicate_total)::BIGINT AS consumer_lag, count(DISTINCT instance_id) AS processor_instances, count(*) AS processor_active_partitions,
  max(hi) AS processing_p95_ms, '2m0s' AS allowed_lateness, '1m0s,5m0s' AS window_sizes, count(*)::INTEGER AS partition_count,
  (SELECT string_agg(id, ',' ORDER BY created_at DESC, id DESC) FROM (SELECT * FROM rejected ORDER BY created_at DESC, id DESC LIMIT 10)) AS rejection_ids
FROM live""", "live", "rejected", "rec", "recent", "ing"),
    "validate_reasons": _with("SELECT n, reason, error, CASE WHEN NOT cut THEN event_id END AS event_id, CASE WHEN NOT cut THEN tenant_id END AS tenant_id FROM judged", "judged"),
    "contract_violation_counts": _with("""SELECT violation, count(*) AS total FROM (SELECT unnest(CASE WHEN cut OR tail THEN ['type: object'] ELSE list_filter([
  CASE WHEN schema_version <> 1 THEN 'schema_version: const' END, CASE WHEN source_id = '' THEN 'source_id: minLength' END,
  CASE WHEN status = 'bad' THEN 'status: enum' END, CASE WHEN sequence < 1 THEN 'sequence: minimum' END,
  CASE WHEN texty THEN 'value: type' END, CASE WHEN extra THEN 'additionalProperties' END], lambda v: v IS NOT NULL) END) AS violation FROM raw) GROUP BY 1""", "raw"),
    "dead_letters": _with("""SELECT make_timestamp(arr_us) AS failed_at, reason, error, 'telemetry.events' AS source_topic, part AS source_partition, off AS source_offset,
  tenant_id || ':' || source_id AS source_key, 'telemetry-processor' AS consumer_group, CASE WHEN cut THEN '' ELSE event_id END AS event_id,
  CASE WHEN cut THEN '' ELSE trim(tenant_id) END AS tenant_id, CASE WHEN cut THEN '' ELSE trim(source_id) END AS source_id,
  to_base64(encode(body)) AS payload_base64, 'trace=' || to_base64(encode(CAST(n AS VARCHAR))) AS headers FROM judged WHERE reason IS NOT NULL""", "judged"),
    "dead_letters_by_reason": _with("SELECT reason, count(*) AS total FROM judged WHERE reason IS NOT NULL GROUP BY 1", "judged"),
    "dead_letter_contract": _with("SELECT count(*) AS records, CAST(0 AS BIGINT) AS violations FROM judged WHERE reason IS NOT NULL", "judged"),
    "admitted_rows": _with("""SELECT request_id, CAST(pos AS INTEGER) AS pos, event_id, tenant_id, make_timestamp(ts_us) AS timestamp, value
FROM elements WHERE request_id IN (SELECT request_id FROM verdicts WHERE reason IS NULL)""", "verdicts"),
    "admitted_singles": _with(f"""SELECT CASE WHEN cut OR extra OR texty THEN 'decode_failed' WHEN trim(tenant_id) <> '{TENANT}' THEN 'forbidden'
  WHEN invalid IS NOT NULL THEN 'validation_failed' ELSE 'accepted' END AS reason, count(*) AS total FROM raw GROUP BY 1""", "raw"),
    "authorized_events": _with(f"SELECT event_id, tenant_id FROM spoiled WHERE tenant_id = '{TENANT}'", "spoiled"),
    "rejections_recent": _with("SELECT id, reason, coalesce(tenant_id, '') AS tenant_id, coalesce(source_id, '') AS source_id, created_at FROM rejected ORDER BY created_at DESC, id DESC LIMIT 10", "rejected"),
    "rejections_by_reason": _with("SELECT reason, count(*) AS total FROM rejected GROUP BY 1", "rejected"),
    "published_log": _with("""SELECT tenant_id || ':' || source_id AS key, '{"schema_version":1,"event_id":"' || event_id || '","tenant_id":"' || tenant_id || '","source_id":"' || source_id
  || '","event_type":"telemetry","timestamp":"' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z","value":' || CAST(value AS VARCHAR)
  || ',"status":"' || status || '","region":"' || region || '","sequence":' || sequence || '}' AS value, make_timestamp(ts_us) AS timestamp FROM tele WHERE copy_no = 0""", "tele"),
    "archive_partitions": _with("SELECT CAST(make_timestamp(ts_us) AS DATE) AS day, tenant_id AS tenant, strftime(make_timestamp(ts_us), '%H') AS hour, count(*) AS line_count FROM tele GROUP BY 1, 2, 3", "tele"),
    "archive_paths": _with("SELECT replace(trim(tenant_id || '/'), '/', '_') AS segment, count(*) AS total FROM spoiled GROUP BY 1", "spoiled"),
    "replayed_events": _with(f"SELECT make_timestamp(arr_us) AS archived_at, event_id, source_id, value FROM tele WHERE tenant_id = '{TENANT}'", "tele"),
    "replayed_limit": _with(f"SELECT make_timestamp(arr_us) AS archived_at, event_id FROM tele WHERE tenant_id = '{TENANT}' ORDER BY date_trunc('hour', make_timestamp(ts_us)), arr_us, event_id LIMIT 25", "tele"),
    "replay_totals": _with(f"SELECT count(DISTINCT (tenant_id, ts_us // 3600000000)) AS files_read, count(*) AS scanned, count(*) FILTER (tenant_id <> '{TENANT}') AS skipped, count(*) FILTER (tenant_id = '{TENANT}') AS replayed FROM tele", "tele"),
    "processor_totals": _with("""SELECT count(DISTINCT instance_id) AS instance_count, sum(processed_total)::BIGINT AS processed_total, sum(duplicate_total)::BIGINT AS duplicate_total,
  sum(late_event_total)::BIGINT AS late_event_total, sum(duplicate_total)::BIGINT AS consumer_lag, count(*) AS active_partitions,
  (SELECT max(m) FROM (SELECT min(lo) AS m FROM live GROUP BY instance_id)) AS processing_p50_ms, max(hi) AS processing_p95_ms, max(hi) + 1 AS processing_p99_ms,
  make_timestamp(max(up_us)) AS last_seen_at FROM live""", "live"),
    "ingest_totals": _with("""SELECT sum(a)::BIGINT AS accepted_total, sum(r)::BIGINT AS rejected_total, make_timestamp(max(u)) AS last_seen_at FROM (
  SELECT count(*) FILTER (status <> 'error') AS a, count(*) FILTER (status = 'error') AS r, max(arr_us) AS u FROM tele GROUP BY region)
WHERE u >= (SELECT max(arr_us) FROM tele) - 120000000""", "tele"),
    "partition_health": _with("""SELECT part AS partition, instance_id AS owner_instance_id, duplicate_total AS lag, processed_total, duplicate_total, late_event_total,
  CAST(0 AS BIGINT) AS inflight_messages, last_offset FROM live""", "live"),
    "hottest_partitions": _with("SELECT part AS partition, instance_id AS owner_instance_id, duplicate_total AS lag FROM live ORDER BY lag DESC, partition, owner_instance_id LIMIT 6", "live"),
    "latest_service_state": _with("""SELECT 'stream-processor' AS service_name, instance_id, CAST(arg_max(part, seen_us) AS VARCHAR) AS payload, make_timestamp(max(seen_us)) AS updated_at
FROM parts GROUP BY 1, 2""", "parts"),
    "heartbeat_class": _with("""SELECT source_id, CASE WHEN s <= 15 THEN 'healthy' WHEN s <= 60 THEN 'stale' ELSE 'offline' END AS freshness
FROM (SELECT source_id, floor(((SELECT max(arr_us) FROM tele) - max(arr_us)) / 1000000 + 0.5) AS s FROM tele GROUP BY 1)""", "tele"),
    "system_status": _with("""SELECT tenant_id, CASE WHEN e / n > 0.2 THEN 'Pressure' ELSE 'Nominal' END AS status, format('{:.2f}%', round(e / n, 6) * 100) AS error_rate,
  format('{:,}', n) AS events, round(least(100.0, (n - e) / n * 100), 6) AS processed_percent
FROM (SELECT tenant_id, count(*) AS n, count(*) FILTER (status = 'error') AS e FROM rec GROUP BY 1)""", "rec"),
    "counter_increase": _with("SELECT instance_id, CAST(sum(inc) AS BIGINT) AS increase FROM grown GROUP BY 1", "grown"),
    "run_rates": _with("""SELECT run_id, secs AS measured_duration_seconds, archived - rej AS accepted_total_delta, processed AS processed_total_delta, dup AS duplicate_total_delta,
  rej AS rejected_total_delta, archived + rej AS producer_sent_total_delta, rej AS producer_failed_total_delta,
  round_even((archived - rej) / greatest(secs, 1), 2) AS accepted_eps, round_even(processed / greatest(secs, 1), 2) AS processed_eps, round_even(rej / greatest(secs, 1), 2) AS rejected_eps,
  round_even((archived + rej) / greatest(secs, 1), 2) AS producer_sent_eps, round_even(rej / greatest(secs, 1), 2) AS producer_failed_eps,
  CASE WHEN archived + rej > 0 THEN round_even((archived - rej) / (archived + rej), 4) ELSE 0.0 END AS offered_to_accepted_ratio FROM deltas""", "deltas"),
    "run_peaks": _with("SELECT run_id, lag::DOUBLE AS peak_consumer_lag, peak AS peak_processing_p95_ms FROM deltas", "deltas"),
    "drain_seconds": _with("""SELECT run_id, round_even(coalesce(min((m_us - at_us) / 1e6) FILTER (m_us >= at_us AND m_us - at_us <= 900000000 AND lag <= target), 900.0), 2) AS post_load_drain_seconds
FROM markers LEFT JOIN runs USING (run_id) GROUP BY 1""", "markers"),
    "recovery_by_lag": _with("""SELECT run_id, make_timestamp(t) AS recovered_at, t IS NOT NULL AS recovered_within_window, round_even((t - at_us) / 1e6, 2) AS recovery_seconds
FROM (SELECT run_id, at_us, min(m_us) FILTER (m_us > at_us AND lag <= 1) AS t FROM markers JOIN runs USING (run_id) GROUP BY 1, 2)""", "markers"),
    "recovery_by_counter": _with("""SELECT run_id, make_timestamp(t) AS recovered_at, t IS NOT NULL AS recovered_within_window, round_even((t - at_us) / 1e6, 2) AS recovery_seconds
FROM (SELECT r.run_id, b.at_us, min(m_us) FILTER (m_us > b.at_us AND processed > b.base) AS t FROM runs r JOIN (
  SELECT run_id, at_us, coalesce(arg_max(processed, m_us) FILTER (m_us <= at_us), arg_max(processed, m_us)) AS base FROM markers JOIN runs USING (run_id) GROUP BY 1, 2) b
  ON b.run_id = r.run_id GROUP BY 1, 2)""", "markers"),
    "accounting_gap": _with("""SELECT run_id, archived AS archived_total_delta, archived - rej AS accepted_total_delta, rej AS publish_failed_total_delta,
  rej AS archived_not_accepted_delta, CAST(0 AS BIGINT) AS archive_accounting_gap FROM deltas""", "deltas"),
    "nearest_rank_percentiles": _with("""SELECT tenant_id, max(c) AS value_count, min(value) FILTER (r >= ceil(0.50 * c)) AS p50, min(value) FILTER (r >= ceil(0.95 * c)) AS p95,
  min(value) FILTER (r >= ceil(0.99 * c)) AS p99 FROM (SELECT tenant_id, value, row_number() OVER (PARTITION BY tenant_id ORDER BY value) AS r, count(*) OVER (PARTITION BY tenant_id) AS c FROM tele) GROUP BY 1""", "tele"),
    "rolling_quantiles": _with("""SELECT partition, max(c) AS value_count, min(value) FILTER (r = floor((c - 1) * 0.50) + 1) AS p50, min(value) FILTER (r = floor((c - 1) * 0.95) + 1) AS p95,
  min(value) FILTER (r = floor((c - 1) * 0.99) + 1) AS p99 FROM (
  SELECT part AS partition, value, row_number() OVER (PARTITION BY part ORDER BY value) AS r, count(*) OVER (PARTITION BY part) AS c
  FROM (SELECT * FROM tele QUALIFY row_number() OVER (PARTITION BY part ORDER BY off DESC) <= 256)) GROUP BY 1""", "tele"),
    "gates": _with("""SELECT run_id, name, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, target, observed, unit FROM (
  SELECT run_id, 'processed_eps_2000' AS name, processed_eps >= 2000 AS ok, 2000.0::DOUBLE AS target, processed_eps AS observed, 'eps' AS unit FROM reports UNION ALL
  SELECT run_id, 'processed_eps_5000', processed_eps >= 5000, 5000.0, processed_eps, 'eps' FROM reports UNION ALL
  SELECT run_id, 'query_p95_250ms', query_p95_ms <= 250, 250.0, query_p95_ms, 'ms' FROM reports UNION ALL
  SELECT run_id, 'post_load_drain_30s', drain <= 30, 30.0, drain, 's' FROM reports)""", "reports"),
    "gap_messages": _with(f"""SELECT run_id, CAST(i - 1 AS INTEGER) AS pos, m[i] AS message FROM (
  SELECT run_id, CASE WHEN len(g) = 0 THEN ['{evidence.GAP_NONE}'] ELSE g END AS m FROM (SELECT run_id, list_filter([
    CASE WHEN accepted_eps < target_eps * 0.8 THEN '{evidence.GAP_ACCEPTED}' END,
    CASE WHEN processed_eps < 2000 THEN '{evidence.GAP_BELOW_2000}' WHEN processed_eps < 5000 THEN '{evidence.GAP_BELOW_5000}' END,
    CASE WHEN peak_lag > 50000 THEN '{evidence.GAP_LAG}' END, CASE WHEN drain > 30 THEN '{evidence.GAP_DRAIN}' END], lambda x: x IS NOT NULL) AS g FROM reports)),
  (SELECT unnest(range(1, 6)) AS i) WHERE i <= len(m)""", "reports"),
    "throughput_by_tenant": _with("""SELECT tenant_id, round_even(count(*) / greatest(floor((max(ts_us) - min(ts_us)) / 1000000), 1.0), 4) AS eps FROM rec GROUP BY 1""", "rec"),
    "lag_alerts": _with(_sustained("SELECT m_us AS t, sum(late + duplicate) AS v FROM mins GROUP BY 1", "v > 1", 120_000_000), "mins"),
    "trailing_rates": _with("""SELECT make_timestamp(m_us) AS sample_ts, sum(g) OVER (ORDER BY m_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 300 AS rate
FROM (SELECT m_us, sum(inc)::DOUBLE AS g FROM grown GROUP BY 1)""", "grown"),
    "rate_alerts": _with(_sustained("""SELECT m_us AS t, sum(g) OVER (ORDER BY m_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 300 AS v
FROM (SELECT m_us, sum(inc)::DOUBLE AS g FROM grown GROUP BY 1)""", "v > 0.2", 60_000_000), "grown"),
    "liveness_alerts": _with(
        _sustained("SELECT m_us AS t, sum((arrived >= 3)::INTEGER) AS v FROM mins GROUP BY 1", "v = 0", 60_000_000, ", 'AllStreamProcessorsDown' AS alert")
        + " UNION ALL " + _sustained("SELECT m_us AS t, count(*) FILTER (arrived < 3) AS v FROM mins GROUP BY 1", "v > 0", 60_000_000, ", 'StreamProcessorReplicaDown' AS alert"), "mins"),
    "admitted_batches": _with("SELECT request_id, events, reason, CAST(pos AS INTEGER) AS pos, tenant_id, source_id FROM verdicts", "verdicts"),
    "rejections": _with("SELECT * FROM rejected", "rejected"),
    "histogram_quantile": _with("SELECT stage, " + ", ".join(
        f"""round_even(min(CASE WHEN c >= {q} * total AND before < {q} * total THEN CASE WHEN le = 'Infinity' THEN lo
  ELSE lo + (le - lo) * (({q} * total - before) / (c - before)) END END) * 1000, 2) AS {name}"""
        for q, name in (("0.5::DOUBLE", "p50_ms"), ("0.95::DOUBLE", "p95_ms"), ("0.99::DOUBLE", "p99_ms"))) + " FROM spans GROUP BY 1", "spans"),
    "drill_summary": _with("SELECT * FROM drills", "drills"),
    "evidence_summary": _with("""SELECT 1 AS schema_version, make_timestamp((SELECT max(b_us) FROM deltas)) AS generated_at, 'available' AS status, 'artifacts' AS artifact_root,
  run_id || '.json' AS artifact, 'Accepted ' || format('{:,.1f}', (archived - rej)::DOUBLE) || ' eps and processed ' || format('{:,.1f}', processed::DOUBLE)
  || ' eps against a 5,000 eps target using 1 producer(s), 0 processor replica(s), and batch size 1.' AS summary,
  (CASE WHEN archived - rej < 4000 THEN 1 ELSE 0 END) + (CASE WHEN processed < 5000 THEN 1 ELSE 0 END) + (CASE WHEN lag > 50000 THEN 1 ELSE 0 END) + 1 AS gap_count,
  (CASE WHEN processed >= 2000 THEN 1 ELSE 0 END) + (CASE WHEN processed >= 5000 THEN 1 ELSE 0 END) + 1 AS gates_passed,
  (SELECT string_agg(status, ',' ORDER BY position) FROM drills) AS drill_states FROM files WHERE kind = 'benchmark'""", "drills"),
})

ORACLE["claims_across_batches"] = ORACLE["partition_progress"]
ORACLE["batch_stats"] = _with(f"""SELECT batch_id, count(*) AS batch_size, count(*) FILTER (disposition = 'recorded') AS recorded_count,
  count(*) FILTER (disposition = 'duplicate') AS duplicate_count, count(*) FILTER (disposition = 'late') AS late_count, 0 AS dead_letter_count,
  count(*) FILTER (rn = 1) AS claim_rows, count(DISTINCT CASE WHEN ok THEN (tenant_id, shard_id, ts_us // 10000000) END) AS tenant_rows,
  count(DISTINCT CASE WHEN ok THEN (tenant_id, source_id) END) AS source_rows,
  count(DISTINCT CASE WHEN ok THEN (tenant_id, source_id, ts_us // 60000000) END)
  + count(DISTINCT CASE WHEN ok THEN (tenant_id, source_id, ts_us // 300000000) END) AS window_rows, 7 AS timed_stages
FROM (SELECT *, CAST(arr_us >= {_CUT} AS BIGINT) AS batch_id, disposition = 'recorded' AS ok FROM cls
  JOIN (SELECT source_id AS sid, {_FNV} AS shard_id FROM (SELECT DISTINCT source_id, encode(tenant_id || chr(0) || source_id) AS b FROM tele)) ON sid = source_id)
GROUP BY 1""", "cls")
ORACLE["stored_overview"] = ORACLE["overview"]
ORACLE["streamed_log"] = _with("""SELECT part AS partition, count(*) AS rows, min(off) AS first_offset, max(off) AS last_offset,
  make_timestamp(max(arr_us)) AS last_seen_at FROM tele GROUP BY 1""", "tele")
ORACLE["bounded_log"] = ORACLE["streamed_log"]
ORACLE["streamed_late_events"] = ORACLE["late_events"]
ORACLE["keyed_partitions"] = _with(f"SELECT k AS key, p AS partition FROM {_KEYED}", "tele")
ORACLE["published_partitions"] = _with(f"""SELECT p AS partition, count(*) AS rows, 0 AS first_offset, count(*) - 1 AS last_offset, count(DISTINCT k) AS keys
FROM tele JOIN {_KEYED} ON sid = source_id GROUP BY 1""", "tele")
ORACLE["keyed_late_events"] = _with(f"""SELECT event_id, p AS partition, make_timestamp(ts_us) AS timestamp, make_timestamp(max_us) AS max_event_time FROM (
  SELECT *, max(ts_us) OVER (PARTITION BY p ORDER BY arr_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS max_us,
    row_number() OVER (PARTITION BY event_id ORDER BY arr_us) AS rn FROM tele JOIN {_KEYED} ON sid = source_id)
WHERE rn = 1 AND max_us - 120000000 > ts_us""", "tele")
_HOURS = f"(SELECT DISTINCT arr_us // 3600000000 AS h, 'run-' || strftime(make_timestamp(arr_us), '%H') AS run_id FROM tele)"
_LETTERS = "(SELECT part % 3 AS i, arr_us // 60000000 * 60000000 AS m_us FROM judged WHERE reason IS NOT NULL)"
ORACLE["dead_letter_deltas"] = _with(f"""SELECT run_id, 'proc-' || i AS instance_id,
  count(*) FILTER (m_us > h * 3600000000 AND m_us <= (h + 1) * 3600000000) AS dead_letter_delta FROM {_HOURS}, {_LETTERS} GROUP BY 1, 2, h""", "judged")
ORACLE["poison_drill"] = _with(f"""SELECT 'poison-message' AS scenario_id, CASE WHEN n > 0 THEN 'verified' ELSE 'degraded' END AS status,
  run_id || '.json' AS artifact, 'Dead-letter delta ' || n || '.' AS result FROM (
  SELECT run_id, h, count(*) FILTER (m_us > h * 3600000000 AND m_us <= (h + 1) * 3600000000) AS n FROM {_HOURS}, {_LETTERS} GROUP BY 1, 2)
ORDER BY h LIMIT 1""", "judged")
ORACLE["deduped_within"] = _with(f"""SELECT event_id, count(DISTINCT ts_us >= {_E} AND ts_us < {_E} + 7200000000)
  + CASE WHEN any_value(ts_us) < {_E} + 7200000000 THEN 1 ELSE 0 END AS passed FROM tele GROUP BY 1""", "tele")
ORACLE["closed_windows"] = _with(f"""SELECT 300 AS window_size_seconds, make_timestamp(w_us) AS window_start, tenant_id, source_id, count(*) AS events_count,
  count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status = 'warn') AS warn_count, count(*) FILTER (status = 'error') AS error_count,
  {_shown("sum(value)")} AS value_sum, make_timestamp(max(ts_us)) AS max_event_at
FROM (SELECT *, ts_us - ts_us % 300000000 AS w_us FROM tele) WHERE w_us + 300000000 <= (SELECT max(ts_us) FROM tele) - 120000000
  AND (arr_us < {_CUT} OR w_us + 300000000 > (SELECT max(ts_us) FROM tele WHERE arr_us < {_CUT}) - 120000000) GROUP BY 2, 3, 4""", "tele")
ORACLE["processor_stream"] = _with("""SELECT tenant_id, source_id, events_count FROM src
UNION ALL SELECT 'dead letters', 'decode_failed', count(*) FROM tele WHERE n % 100 = 0 AND n % 13 <> 0""", "src")
ORACLE["rebuild_outcome"] = _with("SELECT count(*) > 0 AS rebuild_restored FROM rec", "rec")
ORACLE["stored_report"] = f"""SELECT schema_version, status, artifact_root, artifact, gap_count, 5 AS drill_count, drill_states FROM ({ORACLE["evidence_summary"]})
UNION ALL SELECT 1, 'missing', '', NULL, 0, 0, ''"""
ORACLE["stored_samples"] = ORACLE["run_rates"]
_SPOILED = ", ".join(f"({i}, {repr(v) if v else 'NULL'})" for i, (_, _, found) in enumerate(REPORT_SPOILS) for v in (found or (None,)))
ORACLE["report_violations"] = f"SELECT spoil, violation FROM (VALUES {_SPOILED}) AS t(spoil, violation) WHERE (SELECT count(*) FROM events) > 0"
ORACLE["body_limits"] = _with("""SELECT kind || '-' || g AS request_id, CASE WHEN kind = 'sized' AND g % 2 = 1 THEN 0 ELSE count(*) END AS events,
  CASE WHEN count(*) > 500 THEN 'validation_failed' WHEN kind = 'sized' AND g % 2 = 1 THEN 'decode_failed' END AS reason,
  CASE WHEN count(*) > 500 OR (kind = 'sized' AND g % 2 = 1) THEN -1 END AS pos
FROM (SELECT n // 1002 AS g, CASE WHEN n % 1002 < 500 THEN 'full' WHEN n % 1002 < 1001 THEN 'over' ELSE 'sized' END AS kind FROM tele WHERE copy_no = 0)
GROUP BY kind, g UNION ALL SELECT DISTINCT 'none-' || n // 1002, 0, 'validation_failed', -1 FROM tele""", "tele")
ORACLE["ingested_totals"] = _with("""SELECT CAST(sum(CASE WHEN reason IS NULL THEN events ELSE 0 END) AS BIGINT) AS accepted_total,
  count(*) FILTER (reason IS NOT NULL) AS rejected_total FROM verdicts""", "verdicts")
