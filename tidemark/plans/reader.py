"""The read API over stored views: one method per query, each for a principal."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.admission import Principal
from tidemark.plans import queries
from tidemark.plans.scope import require_admin
from tidemark.sources.evidence import read_evidence
from tidemark.sources.overview import answer
from tidemark.sources.views import HotViews


@dataclass
class Reader:
    """Queries that only add up read the deltas unmerged; the others read merged views."""

    views: HotViews
    evidence_path: str = ""

    def _now(self, as_of: Column | None) -> Column:
        self.views.refresh()
        return F.current_timestamp() if as_of is None else as_of

    def overview(self, principal: Principal, as_of: Column | dt.datetime | None = None) -> DataFrame:
        """The dashboard's row from the roll-up: two minutes and one current table.

        Events dated after the minute of ``as_of`` are not of its last minute.
        """
        if isinstance(as_of, Column):
            as_of = self.views.spark.range(1).select(F.unix_micros(as_of)).first()[0]
        elif as_of is None:
            as_of = time.time_ns() // 1000
        else:
            as_of = round(as_of.timestamp() * 1_000_000)
        rows = self.views.overview_rows(as_of)
        return self.overview_from_views(principal, F.timestamp_micros(F.lit(as_of))) if rows is None else answer(rows, principal, as_of)

    def overview_from_views(self, principal: Principal, as_of: Column | None = None) -> DataFrame:
        """The same row from the views themselves, for stores without a roll-up."""
        now, v = self._now(as_of), self.views
        return queries.overview(
            v.deltas("tenant_metric_shards"), v.deltas("tenant_metrics"), v.deltas("source_metrics"),
            v.read("rejection_events"), v.read("service_state"), now, principal)

    def tenant_series(self, principal: Principal, tenant_id: str, window: str | None = None, as_of: Column | None = None) -> DataFrame:
        now, v = self._now(as_of), self.views
        return queries.tenant_series(
            v.deltas("tenant_metric_shards"), v.deltas("tenant_metrics"), tenant_id, now, window, principal)

    def event_windows(
        self, principal: Principal, tenant_id: str | None = None, source_id: str | None = None,
        window_size: str | None = None, lookback: str | None = None, as_of: Column | None = None,
    ) -> DataFrame:
        now, one_source = self._now(as_of), bool((source_id or "").strip())
        windows = self.views.read("event_windows") if one_source else self.views.deltas("event_windows")
        return queries.event_windows(windows, tenant_id, now, source_id, window_size, lookback, principal)

    def top_sources(self, principal: Principal, tenant_id: str | None = None, limit: int = 10) -> DataFrame:
        self.views.refresh()
        return queries.top_sources(self.views.read("source_metrics"), tenant_id, limit, principal)

    def rejections(self, principal: Principal, limit: int = 10) -> DataFrame:
        self.views.refresh()
        return queries.recent_rejections(self.views.read("rejection_events"), limit, principal)

    def partitions(self, principal: Principal, as_of: Column | None = None) -> DataFrame:
        now = self._now(as_of)
        return queries.partitions(self.views.read("service_state"), now, principal)

    def evidence(self, principal: Principal) -> DataFrame:
        require_admin(principal)
        return read_evidence(self.views.spark, self.evidence_path)
