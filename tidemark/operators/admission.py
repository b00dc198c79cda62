"""Request admission: size limits, tenant authorisation, all-or-nothing batches.

A request body holds at most 500 events, all in one row, so the elements of a request
fold back to one verdict on the map side and no group exceeds that bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import evaluated_once, exact_json, trim_space
from tidemark.operators.decode import DECODE_FAILED, VALIDATION_FAILED, classify

MAX_BATCH_EVENTS = 500
SINGLE_BODY_BYTES = 1 << 20
BATCH_BODY_BYTES = 8 << 20
FORBIDDEN = "forbidden"
ADMIN, TENANT_USER, SERVICE = "admin", "tenant_user", "service"


@dataclass(frozen=True)
class Principal:
    """Who asks: role and, for tenant users, their tenant."""

    role: str
    tenant_id: str = ""


def may_publish(principal: Principal, tenant: Column) -> Column:
    """Admins publish for any tenant, tenant users for their own, others never."""
    if principal.role == ADMIN:
        return F.lit(True)
    if principal.role == TENANT_USER:
        own = trim_space(tenant)
        return F.coalesce((own != "") & (own == F.lit(principal.tenant_id)), F.lit(False))
    return F.lit(False)


def authorize_ingest(df: DataFrame, principal: Principal, column: str = "tenant_id") -> DataFrame:
    return df.where(may_publish(principal, F.col(column)))


def _limited(body: Column, limit: int) -> Column:
    """A longer body is read only up to the limit."""
    read = F.decode(F.substring(F.encode(body, "UTF-8"), 1, limit), "UTF-8")
    return F.when(F.octet_length(body) <= limit, body).otherwise(read)


def _judge(df: DataFrame, principal: Principal, col: str, variant: bool = False) -> DataFrame:
    """Decode, then tenant, then rules; a foreign tenant is ``forbidden``."""
    checked = classify(df, col, variant, recover=False)
    foreign = ~may_publish(principal, F.col("event.tenant_id"))
    return checked.withColumn(
        "reason",
        F.when(F.col("reason") == DECODE_FAILED, DECODE_FAILED).when(foreign, FORBIDDEN).otherwise(F.col("reason")),
    )


def admit_single(requests: DataFrame, principal: Principal, col: str = "body") -> DataFrame:
    """One event per body: ``event`` plus ``reason`` (NULL when admitted)."""
    limited = requests.withColumn("__body", _limited(F.col(col).cast("string"), SINGLE_BODY_BYTES))
    return _judge(limited, principal, "__body").drop("__body")


def _parsed(requests: DataFrame, col: str) -> DataFrame:
    body = _limited(F.col(col).cast("string"), BATCH_BODY_BYTES)
    elements = F.try_variant_get(exact_json(body), "$", "array<variant>")
    size = F.size("__elements")
    return requests.withColumn("__elements", elements).withColumn(
        "__shape",
        evaluated_once(
            F.when(F.col("__elements").isNull(), DECODE_FAILED)
            .when((size == 0) | (size > MAX_BATCH_EVENTS), VALIDATION_FAILED)
        ),
    )


def explode_event_batches(requests: DataFrame, col: str = "body") -> DataFrame:
    """Elements of each well-shaped JSON-array body (1..500) as VARIANT, with position."""
    return _parsed(requests, col).where("__shape IS NULL").select(
        *requests.columns, F.posexplode("__elements").alias("pos", "element")
    )


def admit_batches(requests: DataFrame, principal: Principal, key: str = "request_id", col: str = "body") -> DataFrame:
    """One verdict row per request.

    ``reason`` is NULL when the whole batch is admitted; else it is the first failing
    element's reason, with its position, payload and (once decoded) its ids. A body of
    the wrong shape has position -1.
    """
    judged = _judge(explode_event_batches(requests, col).select(key, "pos", "element"), principal, "element", True)
    known = F.col("reason") == VALIDATION_FAILED
    first = F.min_by(
        F.struct(
            "reason", "pos", F.to_json("element").alias("payload"),
            F.when(known, F.col("event.tenant_id")).alias("tenant_id"),
            F.when(known, F.col("event.source_id")).alias("source_id"),
        ),
        F.when(F.col("reason").isNotNull(), F.col("pos")),
    )
    verdict = judged.groupBy(key).agg(F.count(F.lit(1)).alias("events"), first.alias("__first"))
    none = F.lit(None).cast("string")
    misshapen = _parsed(requests, col).where("__shape IS NOT NULL").select(
        key, F.coalesce(F.array_size("__elements"), F.lit(0)).cast("bigint").alias("events"),
        F.struct(F.col("__shape").alias("reason"), F.lit(-1).alias("pos"),
                 F.col(col).cast("string").alias("payload"), none.alias("tenant_id"), none.alias("source_id"))
        .alias("__first"),
    )
    return verdict.unionByName(misshapen).select(key, "events", "__first.*")


def admitted_events(requests: DataFrame, principal: Principal, key: str = "request_id", col: str = "body") -> DataFrame:
    """Events of the requests admitted whole, with their request, position and the element that was sent.

    Bodies are read and elements judged once; the verdict on a request is a count over its elements, of which there are
    at most ``MAX_BATCH_EVENTS``, so no request is joined back.
    """
    judged = _judge(explode_event_batches(requests, col).select(key, "pos", "element"), principal, "element", True)
    refused = F.count("reason").over(Window.partitionBy(key))
    return judged.withColumn("__refused", refused).where("__refused = 0").select(
        key, "pos", "event.*", F.to_json("element").alias("raw_payload"))
