"""Claims: the first arrival of an event id wins, everywhere and for good."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL = ("log_time", "topic", "partition", "offset")


def first_arrivals(log: DataFrame) -> DataFrame:
    """One row per event id: the earliest by (arrival time, partition, offset).

    ``row_number() = 1`` lets Spark cut every map task to one row per id before the
    shuffle, so an id repeated any number of times never piles up in one reducer.
    """
    order = Window.partitionBy("event_id").orderBy(*[c for c in ARRIVAL if c in log.columns])
    return log.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def claim(log: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """Rows that newly claim their event id; ``claimed`` holds ids claimed earlier."""
    winners = first_arrivals(log)
    if claimed is None:
        return winners
    return winners.join(claimed.select("event_id"), "event_id", "left_anti")


def duplicates(log: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of ``log`` that claimed nothing, matched by their unique log position."""
    position = ["topic", "partition", "offset"]
    return log.join(winners.select(*position), position, "left_anti")


def dedup_within(stream: DataFrame, delay: str, time_column: str = "timestamp") -> DataFrame:
    """Bounded-state variant: an id is remembered only for ``delay`` of event time."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["event_id"])
