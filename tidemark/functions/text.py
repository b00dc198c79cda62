"""String, JSON and display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_FIELDS

# Microsecond ISO text with a zone, so encode -> decode keeps event time exact.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
UNKNOWN_TENANT = "_unknown"
_END = "__end_of_document__"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base64_text(c: Column) -> Column:
    """Base64 on one line (Spark's own breaks lines every 76 characters)."""
    return F.translate(F.base64(c), "\r\n", "")


def evaluated_once(c: Column) -> Column:
    """Keep filters on this column above the projection that computes it.

    Predicate pushdown copies a column's whole expression into the filter, and a JSON
    parse below it into every place it is used. It never passes a projection holding a
    non-deterministic expression, so a seeded ``rand`` (always true here) pins it.
    """
    return F.when(F.rand(0) + 1 > 0, c)


def is_blank(c: Column | str) -> Column:
    """NULL or only (Unicode) white space; a printable ASCII start spares the pattern."""
    printable = F.ascii(F.ltrim(_col(c))).between(33, 126)
    return ~F.coalesce(printable | _col(c).rlike(r"(?U)\S"), F.lit(False))


def trim_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), _col(c))


def null_to_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def partition_key(tenant: Column | str = "tenant_id", source: Column | str = "source_id") -> Column:
    return F.concat_ws(":", null_to_empty(tenant), null_to_empty(source))


def path_segment(tenant: Column | str) -> Column:
    """Tenant id as one path segment: never empty, never holding a separator."""
    safe = F.translate(F.trim(_col(tenant)), "/\\", "__")
    return F.coalesce(F.when(safe != "", safe), F.lit(UNKNOWN_TENANT))


def event_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + name).alias(name) for name in EVENT_FIELDS])


def encode_event(event: Column) -> Column:
    """JSON text of an event struct; a missing or zero version becomes 1."""
    version = event.getField("schema_version")
    fixed = event.withField(
        "schema_version",
        F.when(F.coalesce(version, F.lit(0)) == 0, F.lit(1).cast("bigint")).otherwise(version.cast("bigint")),
    )
    return F.to_json(fixed, {"timestampFormat": TIME_FORMAT})


def exact_json(text: Column | str) -> Column:
    """VARIANT of a text that is exactly one JSON document, else NULL.

    ``try_parse_json`` stops after the first value; parsing the text as the first
    element of an array with an end marker exposes anything that follows it.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), _col(text), F.lit(f',"{_END}"]')))

    def complete(doc: Column) -> Column:
        third = F.try_variant_get(doc, "$[2]", "variant").isNull()
        return F.coalesce(F.try_variant_get(doc, "$[1]", "string") == _END, F.lit(False)) & third

    # the one-element array binds the parsed value, so the text is parsed once
    return F.try_variant_get(F.get(F.filter(F.array(boxed), complete), F.lit(0)), "$[0]", "variant")


def display_number(c: Column | str, digits: int = 0) -> Column:
    return F.format_number(_col(c), digits)


def display_percent(ratio: Column | str) -> Column:
    return F.concat(F.format_number(_col(ratio) * 100, 2), F.lit("%"))
