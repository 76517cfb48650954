"""Ids, keys and times that are given from outside or follow from the row, so that a task that runs again makes the same ones."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what an API key begins with, before the tenant's name.
KEY_START = "tenant_"


def row_uuid(*parts: Column) -> Column:
    """A UUID of version 3 and the RFC's variant that follows from the parts; null parts count, and differ from empty ones."""
    whole = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts))
    h = F.md5(whole.cast("binary"))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def new_key(slug: str, token: Callable[[int], str] = secrets.token_hex) -> str:
    """A fresh API key of a tenant; ``token`` may be given."""
    return f"{KEY_START}{slug}_{token(20)}"


def stamped(rows: DataFrame, now: datetime, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """The rows with the time of their making, where they have none, and of their last change."""
    at = F.lit(now).cast("timestamp")
    first = F.coalesce(F.col(created), at) if created in rows.columns else at
    return rows.withColumns({created: first, updated: at})
