"""Small builders shared by the tests."""

import json

BASE = {
    "schema_version": 1, "event_id": "e-0007", "tenant_id": "harbour", "source_id": "gauge-31",
    "event_type": "telemetry", "timestamp": "2025-08-21T06:30:15Z", "value": -3.25, "status": "ok",
    "region": "ap-south", "sequence": 44,
}
DROP = object()


def payload(**changes):
    doc = {**BASE, **changes}
    return json.dumps({k: v for k, v in doc.items() if v is not DROP})


def rows(df, *order):
    found = df.orderBy(*order).collect() if order else df.collect()
    return [tuple(r) for r in found]


def unordered(df):
    """All rows as comparable tuples, in a canonical order."""
    names = sorted(df.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in df.collect())
