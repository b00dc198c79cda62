"""Raw event archive: NDJSON partitioned by event day, tenant and hour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import TIME_FORMAT, encode_event, event_struct, exact_json, path_segment
from tidemark.functions.timeparts import hour_label, is_zero_time, utc_day
from tidemark.schemas import ARCHIVE_LINE, POSITION

PARTITIONS = ("day", "tenant", "hour")
MAX_RECORDS_PER_FILE = 5_000_000


def position(**known: Column) -> Column:
    """Fields of ``POSITION``; those that are not known are null."""
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POSITION])


def log_position() -> Column:
    """The position of a log row."""
    return position(**{c: F.col(c) for c in ("topic", "partition", "offset", "log_time")})


def archive_rows(events: DataFrame, raw_payload: Column, archived_at: Column, stood: Column | None = None) -> DataFrame:
    """Archive lines with their partition columns.

    A raw payload that is valid JSON is kept as sent, anything else is replaced by the
    encoded event. The partition follows event time, or archive time when there is none. A batch is stamped alike, so
    only the position (``stood``) tells the order of its events.
    """
    event = event_struct()
    filed = F.when(is_zero_time("timestamp"), archived_at).otherwise(F.col("timestamp"))
    raw = F.when(exact_json(raw_payload).isNotNull(), raw_payload).otherwise(encode_event(event))
    return events.select(
        archived_at.alias("archived_at"), event.alias("event"), raw.alias("raw_payload"),
        (F.lit(None).cast(POSITION) if stood is None else stood).alias("position"),
        utc_day(filed).alias("day"), path_segment("tenant_id").alias("tenant"), hour_label(filed).alias("hour"),
    )


def _line() -> Column:
    """One NDJSON line with the raw payload embedded as it came; only a payload that
    spans several text lines is re-printed compactly."""
    raw = F.col("raw_payload")
    flat = F.when(raw.rlike(r"[\r\n]"), F.to_json(F.try_parse_json(raw))).otherwise(raw)
    return F.concat(
        F.lit('{"archived_at":"'), F.date_format("archived_at", TIME_FORMAT), F.lit('","event":'),
        encode_event(F.col("event")), F.lit(',"raw_payload":'), flat,
        F.coalesce(F.concat(F.lit(',"position":'), F.to_json("position", {"timestampFormat": TIME_FORMAT})), F.lit("")), F.lit("}"),
    )


def write_archive(rows: DataFrame, root: str) -> None:
    """Append to the archive.

    The rebalance hint lets AQE gather small (day, tenant, hour) groups into few files
    and split one that holds a large share of the data over many tasks.
    """
    lines = rows.select(_line().alias("value"), *PARTITIONS)
    (
        lines.hint("rebalance", *PARTITIONS)
        .write.mode("append").partitionBy(*PARTITIONS)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).text(root)
    )


def day_range(start: str, end: str | None = None) -> tuple[dt.date, dt.date]:
    """Inclusive range of ``YYYY-MM-DD`` days; the end defaults to the start."""
    try:
        first = dt.datetime.strptime(start.strip(), "%Y-%m-%d").date()
    except ValueError as exc:
        raise ValueError("start_date must use YYYY-MM-DD") from exc
    try:
        last = dt.datetime.strptime(end.strip(), "%Y-%m-%d").date() if end and end.strip() else first
    except ValueError as exc:
        raise ValueError("end_date must use YYYY-MM-DD") from exc
    if last < first:
        raise ValueError("end_date must be on or after start_date")
    return first, last


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern names, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found) if found is not None else []


_STORED = ARCHIVE_LINE


def read_archive(
    spark: SparkSession, root: str, start: str, end: str | None = None, tenant: str | None = None,
) -> DataFrame:
    """Archive lines of a day range: ``archived_at, event, raw_payload, position, path``.

    Only the partitions of those days (and of the tenant's folder) are listed and read.
    A line that cannot be parsed aborts the read.
    """
    first, last = day_range(start, end)
    parts = [_read_partitioned(spark, root, first, last, tenant), _read_dated(spark, root, first, last, tenant)]
    present = [p for p in parts if p is not None]
    if not present:
        schema = T.StructType([*_STORED.fields, T.StructField("path", T.StringType())])
        return spark.createDataFrame([], schema)
    result = present[0]
    for part in present[1:]:
        result = result.unionByName(part)
    return result


def _within(day: str, first: dt.date, last: dt.date) -> bool:
    try:
        return first <= dt.date.fromisoformat(day) <= last
    except ValueError:
        return False


def _read_partitioned(spark, root, first, last, tenant) -> DataFrame | None:
    """Lists the day folders by name, then reads only the wanted ones (and the tenant's folder in each)."""
    days = [p.rsplit("day=", 1)[1] for p in _matching(spark, f"{root}/day=*")]
    wanted = [d for d in days if _within(d, first, last)]
    if not wanted:
        return None
    folder = f"/tenant={_segment(tenant)}" if tenant and tenant.strip() else ""
    paths = _matching(spark, f"{root}/day={{{','.join(wanted)}}}{folder}")
    if not paths:
        return None
    schema = T.StructType([
        *_STORED.fields, T.StructField("day", T.DateType()), T.StructField("tenant", T.StringType()),
        T.StructField("hour", T.StringType()),
    ])
    lines = spark.read.schema(schema).option("mode", "FAILFAST").option("basePath", root).json(paths)
    return lines.select(*_STORED.fieldNames(), F.col("_metadata.file_path").alias("path"))


def _read_dated(spark, root, first, last, tenant) -> DataFrame | None:
    """The older ``root/Y/M/D/[tenant/hour/]events*.ndjson`` layout; missing paths are skipped."""
    folder = _segment(tenant) if tenant and tenant.strip() else "*"
    digits = "[0-9][0-9]"
    days = _matching(spark, f"{root}/{digits}{digits}/{digits}/{digits}")
    wanted = [p for p in days if _within("-".join(p.rsplit("/", 3)[1:]), first, last)]
    paths = [p for day in wanted for p in (
        _matching(spark, f"{day}/{folder}/*/events*.ndjson") + _matching(spark, f"{day}/events*.ndjson"))]
    if not paths:
        return None
    return (
        spark.read.schema(_STORED).option("mode", "FAILFAST").json(paths)
        .select(*_STORED.fieldNames(), F.col("_metadata.file_path").alias("path"))
    )


def _segment(tenant: str) -> str:
    return tenant.strip().replace("/", "_").replace("\\", "_") or "_unknown"


