"""Vector columns in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero or null vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def floats(v: Column) -> Column:
    """Any numbers as the vectors that tables keep."""
    return v.cast("array<float>")


def text_form(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
