"""Array columns: values used twice, running sums, run lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(a: Column, start: Column) -> Column:
    """start, start + a[0], start + a[0] + a[1], ..."""
    return F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def sums_before(a: Column) -> Column:
    """For each place of an array of bigint the sum of what lies before it. Works in chunks, so that the copying stays
    small beside a long array."""

    def some(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        return let(cut, lambda chunks: let(
            _running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long")),
            lambda starts: F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, t: F.slice(_running(c, t), F.lit(1), F.size(c)))),
        ))

    return let(a, lambda v: F.when(F.size(v) > 0, some(v)).otherwise(F.array().cast("array<bigint>")))


def totals(a: Column) -> Column:
    """array<struct<value, n>> with the ``n`` of equal values added up, by value."""

    def sums(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["value"] != F.get(s, i - 2)["value"]))
        n = lambda h, i, at: F.aggregate(F.slice(s, h, F.coalesce(F.get(at, i + 1), F.size(s) + 1) - h), F.lit(0).cast("long"), lambda t, x: t + x["n"])
        return let(heads, lambda at: F.transform(at, lambda h, i: F.struct(F.element_at(s, h)["value"].alias("value"), n(h, i, at).alias("n"))))

    return let(F.sort_array(a), lambda s: F.when(F.size(s) > 0, sums(s)))


def tally(a: Column) -> Column:
    """array<struct<value, n>>: how often each value of ``a`` is there, by value."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))
        return let(heads, lambda h: F.transform(h, lambda at, j: F.struct(F.element_at(s, at).alias("value"), (F.coalesce(F.get(h, j + 1), F.size(s) + 1) - at).cast("long").alias("n"))))

    return let(F.sort_array(a), lambda s: F.when(F.size(s) > 0, runs(s)))
