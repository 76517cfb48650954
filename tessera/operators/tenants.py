"""Tenant scoping and key lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantView:
    """Tables narrowed to one tenant before anything else can be asked of them."""

    slug: str

    def of(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("tenant_slug") == self.slug)


def by_key(tenants: DataFrame, key: str) -> DataFrame:
    return tenants.where(F.col("api_key") == key)


def authenticate(tenants: DataFrame, key: str | None) -> TenantView:
    found = by_key(tenants, key).select("slug").limit(2).collect() if key else []
    if len(found) != 1:
        raise PermissionError("unknown key")
    return TenantView(found[0]["slug"])


def key_of(header_key: Column, authorization: Column) -> Column:
    return F.coalesce(header_key, F.when(authorization.startswith("Bearer "), authorization.substr(F.lit(8), F.length(authorization))))


def require_admin(view: TenantView) -> None:
    if view.slug != "admin":
        raise PermissionError("admin only")


def by_creation(tenants: DataFrame) -> DataFrame:
    """Tenants in the order they came, those without a time last."""
    return tenants.orderBy(F.asc_nulls_last("created_at"), "slug")


def with_total(tenants: DataFrame) -> DataFrame:
    """Each tenant beside the number of all."""
    return tenants.join(F.broadcast(tenants.agg(F.count("*").alias("total"))))  # one row


def only(rows: DataFrame, condition: Column) -> DataFrame:
    """The one row that the condition holds for, or none; that it holds for more is an error when the result is read."""
    found = rows.where(condition).limit(2)
    n = found.agg(F.count("*").alias("__n"))
    checked = found.join(F.broadcast(n)).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True)).cast("boolean"))
    return checked.where("__ok").select(*rows.columns)


def present(files: DataFrame) -> DataFrame:
    """Rows that are not marked as deleted."""
    return files.where(F.col("deleted_at").isNull())


def first_ordinary(tenants: DataFrame) -> DataFrame:
    """The first tenant, by slug, that is no admin."""
    return tenants.where((F.col("slug") != "admin") & (F.col("name") != "admin")).orderBy("slug").limit(1)


def key_by_slug(tenants: DataFrame, slug: str, *fallbacks: str | None) -> str | None:
    """An active tenant's key, or the first fallback that is not empty."""
    found = tenants.where((F.col("slug") == slug) & F.col("is_active")).select("api_key").limit(1).collect()
    return next((k for k in ([found[0]["api_key"]] if found else []) + list(fallbacks) if k), None)
