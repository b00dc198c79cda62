"""Event-time arithmetic on microseconds, independent of session settings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
_UNITS_US = {"ns": 1e-3, "us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Tumbling bucket start; sizes must divide a day so buckets align with midnight."""
    if seconds <= 0 or DAY_SECONDS % seconds:
        raise ValueError(f"bucket size must divide a day, got {seconds}s")
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def duration_seconds(text: str | None, default: str, positive: bool = True) -> float:
    """Parse duration text such as ``15m`` or ``1m30s``."""
    raw = (text or default).strip()
    sign, body = (-1, raw[1:]) if raw[:1] == "-" else (1, raw.lstrip("+"))
    if body == "0":
        total = 0.0
    else:
        parts = _PART.findall(body)
        if not parts or "".join(n + u for n, u in parts) != body:
            raise ValueError(f"invalid duration {text!r}")
        total = sign * sum(float(n) * _UNITS_US[u] for n, u in parts) / 1_000_000
    if positive and total <= 0:
        raise ValueError(f"duration must be positive, got {text!r}")
    return total


def duration_label(seconds: float) -> str:
    """Canonical duration text: 60 -> ``1m0s``, 90061 -> ``25h1m1s``."""
    if 0 < abs(seconds) < 1:
        return f"{seconds * 1000:g}ms"
    sign, rest = ("-", -seconds) if seconds < 0 else ("", seconds)
    hours, rest = divmod(rest, 3600)
    minutes, secs = divmod(rest, 60)
    text = f"{secs:g}s"
    if hours or minutes:
        text = f"{int(minutes)}m{text}"
    if hours:
        text = f"{int(hours)}h{text}"
    return sign + text


def window_label(seconds: Column | str) -> Column:
    """Column form of :func:`duration_label` for whole seconds."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    hours, minutes, secs = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(s >= 3600, F.format_string("%dh%dm%ds", hours, minutes, secs))
        .when(s >= 60, F.format_string("%dm%ds", minutes, secs))
        .otherwise(F.format_string("%ds", secs))
    )


def minus_seconds(ts: Column, seconds: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - F.lit(round(seconds * 1_000_000)))


def millis_between(later: Column, earlier: Column | str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000.0


def seconds_between(later: Column, earlier: Column | str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def is_zero_time(ts: Column | str) -> Column:
    """Missing, or the first instant of year 1."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return col.isNull() | (col == F.lit("0001-01-01 00:00:00").cast("timestamp"))


def utc_day(ts: Column | str) -> Column:
    """Calendar day in UTC (the session time zone is pinned to UTC)."""
    return F.to_date(ts)


def hour_label(ts: Column | str) -> Column:
    return F.date_format(ts, "HH")


def parse_day(text: Column | str) -> Column:
    """Strict ``YYYY-MM-DD``; anything else is NULL."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
