"""Strict JSON decode, ordered validation and failure reasons, all as expressions.

One VARIANT parse per payload. The printed schema of that VARIANT lists every key (in
sorted order, odd names quoted) with its JSON type, so a single pattern decides both
"no unknown field" and "every field has its exact JSON type".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import evaluated_once, exact_json, is_blank
from tidemark.functions.timeparts import is_zero_time
from tidemark.schemas import EVENT

SCHEMA_VERSION = 1
STATUSES = ("ok", "warn", "error")
DECODE_FAILED, VALIDATION_FAILED = "decode_failed", "validation_failed"

# JSON type each field must print as; VOID is an explicit null.
_JSON_TYPES = {"string": "STRING", "long": "BIGINT", "double": r"(?:BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT)",
               "timestamp": "STRING"}
_FIELD_TYPES = {f.name: _JSON_TYPES[f.dataType.typeName()] for f in EVENT.fields}
_STRICT = r"^OBJECT<(?:(?:" + "|".join(f"{n}: (?:{t}|VOID)" for n, t in sorted(_FIELD_TYPES.items())) + r")(?:, |(?=>)))*>$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _get(root: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(root, f"$.{name}", kind)


def _fields(root: Column, time: Column, number: Column, has_type) -> Column:
    """The event struct; ``has_type(name)`` tells whether a field may be read."""
    fields = []
    for f in EVENT.fields:
        kind = f.dataType.typeName()
        if kind == "timestamp":
            value = time
        elif kind == "double":
            value = F.coalesce(F.when(has_type(f.name) & _finite(number), number), F.lit(0.0))
        elif kind == "long":
            value = F.coalesce(F.when(has_type(f.name), _get(root, f.name, "bigint")), F.lit(0).cast("bigint"))
        else:
            value = F.when(has_type(f.name), _get(root, f.name, "string"))
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def _finite(number: Column) -> Column:
    return F.abs(number) < F.lit(float("inf"))


def decode(df: DataFrame, col: str = "value", variant: bool = False) -> DataFrame:
    """Add ``event`` (struct, filled where fields have the right type) and ``decode_error``.

    ``decode_error`` is NULL for a strictly valid payload. Text after the first JSON
    value is ignored, as a stream decoder does; a bare ``null`` is an empty event.
    The type pattern settles all fields of a good payload at once; only a failed one is
    looked at field by field.
    """
    text = F.col(col).cast("string") if not variant else None
    root, schema, time, number = (F.col(c) for c in ("__root", "__schema", "__time", "__number"))
    time_text = F.col("__time_text")
    parsed = (
        df.withColumn("__root", F.col(col) if variant else F.try_parse_json(text))
        .withColumns({
            "__schema": F.schema_of_variant("__root"), "__time_text": _get(root, "timestamp", "string"),
            "__number": _get(root, "value", "double"),
        })
        .withColumn("__time", F.when(time_text.rlike(RFC3339), F.try_to_timestamp(time_text)))
    )
    # what the type pattern cannot see: RFC 3339 time text and a finite number
    fits = (time_text.isNull() | time.isNotNull()) & (number.isNull() | _finite(number))
    strict = F.coalesce((schema == "VOID") | (schema.rlike(_STRICT) & fits), F.lit(False))
    parsed = parsed.withColumn("__strict", strict)
    is_object = F.coalesce(schema.startswith("OBJECT<"), F.lit(False))

    def typed(name: str) -> Column:
        return schema.rlike(rf"[<\s]{name}: (?:{_FIELD_TYPES[name]})[,>]")

    event = F.when(F.col("__strict"), _fields(root, time, number, lambda name: F.lit(True))).otherwise(
        _fields(root, F.when(is_object, time), number, lambda name: is_object & typed(name))
    )
    known = F.array(*[F.lit(n) for n in EVENT.fieldNames()])
    keys = F.map_keys(F.try_variant_get(root, "$", "map<string,variant>"))
    unknown = F.try_element_at(F.array_except(keys, known), F.lit(1))
    error = (
        F.when(F.col("__strict"), F.lit(None).cast("string"))
        .when(root.isNull(), "decode event: invalid JSON")
        .when(~is_object, "decode event: JSON object expected")
        .when(unknown.isNotNull(), F.format_string('decode event: unknown field "%s"', unknown))
        .otherwise("decode event: field has the wrong type")
    )
    # Lenient reading allows unknown fields but no mistyped known one and no trailing text.
    whole = F.lit(True) if variant else exact_json(text).isNotNull()
    lenient = F.when(
        F.col("__strict") | ~is_object, F.lit(False)
    ).otherwise(_known_fields_typed(schema) & F.coalesce(fits, F.lit(False)) & whole)
    return parsed.withColumns({"event": event, "decode_error": error, "__lenient": lenient}).drop(
        "__schema", "__time_text", "__number", "__time", "__strict"
    )


def _known_fields_typed(schema: Column) -> Column:
    return ~F.reduce(
        F.array(*[
            schema.rlike(rf"[<\s]{n}: ") & ~schema.rlike(rf"[<\s]{n}: (?:{t}|VOID)[,>]")
            for n, t in _FIELD_TYPES.items()
        ]),
        F.lit(False), lambda a, b: a | b,
    )


def validation_error(event: str | None = "event") -> Column:
    """First failing rule's message, or NULL. ``event=None`` reads top-level columns."""
    def c(name: str) -> Column:
        return F.col(f"{event}.{name}" if event else name)

    def rule(failed: Column, message: str) -> Column:
        return F.when(failed, message)

    return F.coalesce(
        rule(~F.coalesce(c("schema_version") == SCHEMA_VERSION, F.lit(False)),
             f"schema_version must be {SCHEMA_VERSION}"),
        *[rule(is_blank(c(n)), f"{n} is required")
          for n in ("event_id", "tenant_id", "source_id", "event_type")],
        rule(is_zero_time(c("timestamp")), "timestamp is required"),
        rule(~F.coalesce(c("status").isin(*STATUSES), F.lit(False)), "status must be one of ok, warn, error"),
        rule(~F.coalesce(c("sequence") > 0, F.lit(False)), "sequence must be greater than zero"),
    )


def classify(df: DataFrame, col: str = "value", variant: bool = False, recover: bool = True) -> DataFrame:
    """Decode and validate: ``event``, ``reason`` (NULL when valid) and ``error``.

    With ``recover``, an undecodable payload that still reads leniently and breaks a
    rule counts as ``validation_failed`` with its ids recovered.
    """
    decoded = decode(df, col, variant).withColumn("__invalid", validation_error())
    strict, invalid = F.col("decode_error").isNull(), F.col("__invalid").isNotNull()
    checked = (F.col("__lenient") | strict) if recover else strict
    return (
        decoded
        .withColumn(
            "reason", evaluated_once(F.when(checked & invalid, VALIDATION_FAILED).when(~strict, DECODE_FAILED))
        )
        .withColumn("error", F.when(checked & invalid, F.col("__invalid")).otherwise(F.col("decode_error")))
        .drop("__root", "__lenient", "__invalid", "decode_error")
    )


def accepted(classified: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows, flattened to event columns plus the ``keep`` columns."""
    return classified.where("reason IS NULL").select("event.*", *keep)
