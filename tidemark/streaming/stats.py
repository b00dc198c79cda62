"""Progress of a running query. What a batch did is in the view ``batch_stats``, one row a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

PROGRESS = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("rows_per_second", T.DoubleType()),
    T.StructField("trigger_ms", T.LongType()), T.StructField("stages_ms", T.MapType(T.StringType(), T.LongType())),
])


def _row(p) -> tuple:
    stages = {k: int(v) for k, v in p["durationMs"].items()}
    return (str(p["runId"]), p["batchId"], p["numInputRows"], float(p.get("processedRowsPerSecond") or 0.0),
            stages.get("triggerExecution", 0), stages)


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The retained progress reports (Spark keeps the last hundred) as rows."""
    return spark.createDataFrame([_row(p) for p in query.recentProgress], PROGRESS)
