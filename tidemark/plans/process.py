"""One pass from decoded log rows to hot-view deltas.

Stream, replay, rebuild and batch queries all call :func:`process_batch`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import base_grain, event_windows, source_metrics, tenant_shards
from tidemark.operators.dedup import claim
from tidemark.operators.dispositions import partition_progress
from tidemark.operators.lateness import ALLOWED_LATENESS_SECONDS, OFFSETS_PER_BLOCK, mark_late


@dataclass(frozen=True)
class Processed:
    """Lazy results of one batch."""

    log: DataFrame
    marked: DataFrame
    winners: DataFrame

    @property
    def recorded(self) -> DataFrame:
        """Claimed and on time: the only rows that reach an aggregate."""
        return self.winners.where(~F.col("late"))

    @property
    def late(self) -> DataFrame:
        return self.winners.where("late")

    @property
    def progress(self) -> DataFrame:
        return partition_progress(self.log, self.winners)

    @property
    def grain(self) -> DataFrame:
        return base_grain(self.recorded)


def process_batch(
    log: DataFrame,
    claimed: DataFrame | None = None,
    marks: DataFrame | None = None,
    lateness_seconds: float = ALLOWED_LATENESS_SECONDS,
    block: int = OFFSETS_PER_BLOCK,
    ties: tuple[str, ...] = (),
) -> Processed:
    """Mark lateness over all valid rows, then claim ids; duplicates never count as late."""
    marked = mark_late(log, lateness_seconds, marks, block, ties)
    return Processed(log, marked, claim(marked, claimed))


def view_deltas(grain: DataFrame) -> dict[str, DataFrame]:
    """The three additive view deltas of one batch."""
    return {
        "tenant_metric_shards": tenant_shards(grain),
        "source_metrics": source_metrics(grain),
        "event_windows": event_windows(grain),
    }
