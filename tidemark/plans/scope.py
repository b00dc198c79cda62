"""Row-level tenant scope for every view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.admission import ADMIN, SERVICE, TENANT_USER, Principal


class Forbidden(PermissionError):
    """The principal may not ask this."""


def scoped(df: DataFrame, principal: Principal) -> DataFrame:
    """Admin and service see all rows; others only their tenant's (never NULL-tenant ones).

    A view without a tenant column is hidden from everyone else. The filter is a plain
    predicate, so it reaches the scan.
    """
    if principal.role in (ADMIN, SERVICE, ""):
        return df
    if "tenant_id" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.col("tenant_id") == F.lit(principal.tenant_id))


def requested_tenant(principal: Principal, tenant_id: str | None, required: bool = True) -> str:
    """The tenant a query runs for: a tenant user defaults to, and may only ask, its own."""
    tenant = (tenant_id or "").strip()
    if principal.role == TENANT_USER:
        if tenant and tenant != principal.tenant_id:
            raise Forbidden("token tenant does not match requested tenant")
        tenant = principal.tenant_id
    if required and not tenant:
        raise ValueError("tenantId is required")
    return tenant


def require_admin(principal: Principal) -> None:
    if principal.role != ADMIN:
        raise Forbidden("admin role is required")
