"""Report files: evidence, drill and benchmark artifacts, metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import BENCHMARK, DRILL, EVIDENCE, SAMPLE

_BOM = "﻿"


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """One report as one row.

    A missing or blank file gives the default summary with status ``missing``; a
    byte-order mark is dropped; absent lists become empty. Broken JSON is an error.
    """
    path = path.strip()
    empty = spark.createDataFrame([("",)], "value string")
    text = spark.read.text(path, wholetext=True) if path and _exists(spark, path) else empty
    body = F.regexp_replace("value", f"^{_BOM}", "")
    # the default applies when the text is blank; malformed text fails the read
    doc = F.from_json(F.when(F.trim(body) == "", F.lit("{}")).otherwise(body), EVIDENCE, {"mode": "FAILFAST"})
    return text.select(doc.alias("r")).select(*_with_defaults(F.col("r"), path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _with_defaults(r: Column, path: str) -> list[Column]:
    now = F.current_timestamp()
    bench = F.when(r["benchmark"].isNotNull(), F.struct(*[
        (F.coalesce(r["benchmark"][f.name], F.array().cast(f.dataType)) if f.name in ("gaps", "gates")
         else r["benchmark"][f.name]).alias(f.name)
        for f in BENCHMARK.fields
    ]))
    drills = F.transform(r["failure_drills"], lambda d: F.struct(*[
        (F.coalesce(d[f.name], F.array().cast(f.dataType)) if f.name == "metrics" else d[f.name]).alias(f.name)
        for f in DRILL.fields
    ]))
    status = F.coalesce(r["status"], F.lit("missing"))
    root = F.coalesce(r["artifact_root"], F.lit(path))
    return [
        F.when(F.coalesce(r["schema_version"], F.lit(0)) == 0, F.lit(1)).otherwise(r["schema_version"])
        .cast("bigint").alias("schema_version"),
        F.coalesce(r["generated_at"], now).alias("generated_at"),
        F.when(status == "", "available").otherwise(status).alias("status"),
        F.when(root == "", F.lit(path)).otherwise(root).alias("artifact_root"),
        bench.alias("benchmark"),
        F.coalesce(drills, F.array().cast(EVIDENCE["failure_drills"].dataType)).alias("failure_drills"),
    ]


def read_report_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Artifact files as rows ``(kind, artifact, modified_at, payload)``.

    The kind is the file name up to its trailing date, e.g. ``broker-outage``.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(pattern, wholetext=True)
    name = F.col("_metadata.file_name")
    return files.select(
        F.regexp_replace(name, r"-\d{6,}.*$|\.json$", "").alias("kind"),
        F.col("_metadata.file_path").alias("artifact"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.regexp_replace("value", f"^{_BOM}", "").alias("payload"),
    )


def latest_per_key(df: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row per key, as a mergeable aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, *[f"r.{c}" for c in rest])


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(SAMPLE).load(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON document per row; a report is a single small row."""
    report.coalesce(1).write.mode("overwrite").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)
