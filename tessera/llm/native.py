"""Small building blocks on array columns, all inside the JVM."""

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


def prefix_sums(a: Column) -> Column:
    """Inclusive running sums of an array of bigint, in chunks, so that the copying stays small beside the array."""

    def some(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        return let(cut, lambda chunks: let(
            _running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0).cast("long")),
            lambda starts: F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, t: F.slice(_running(c, t), F.lit(2), F.size(c)))),
        ))

    return let(a, lambda v: F.when(F.size(v) > 0, some(v)).otherwise(F.array().cast("array<bigint>")))


def match_spans(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points; ``value`` is a group's text."""
    def spans(found: Column) -> Column:
        between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
        steps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda n, i: n + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0)))
        values = found if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        return let(prefix_sums(steps), lambda starts: let(values, lambda vs: F.transform(found, lambda m, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), F.get(vs, i).alias("value")))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)
