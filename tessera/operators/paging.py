"""Sorted tables with known positions: pages of long lists, and deep pages that read one range or two.

``ranked`` range-partitions and sorts a table once and writes it, a folder a range, each row with its place in its range.
How many rows of each group a range holds then gives every row's position, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import shared_folder

RANGE_ROWS = 100_000  # rows of a range, about


def ranked(rows: DataFrame, order: Sequence[str], path: str | None = None, ranges: int | None = None) -> tuple[DataFrame, str]:
    """The rows, sorted by ``order`` over all ranges, with ``__range`` and ``__at`` (the place in the range, from 0), and their
    folder. Rows equal in ``order`` are told apart by the hash of all columns, so that copies fill more than one range."""
    spark = rows.sparkSession
    path = path or shared_folder(spark, "ranked")
    ranges = ranges or max(1, -(-rows.count() // RANGE_ROWS))
    tie = F.xxhash64(*rows.columns)
    out = rows.withColumn("__tie", tie).repartitionByRange(ranges, *order, "__tie").sortWithinPartitions(*order, "__tie")
    number = F.monotonically_increasing_id()
    placed = out.withColumn("__n", number).withColumns({"__range": F.shiftright("__n", 33).cast("int"), "__at": F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))})
    placed = placed.drop("__n", "__tie")
    placed.write.mode("overwrite").partitionBy("__range").parquet(path)
    schema = T.StructType([*(f for f in placed.schema if f.name != "__range"), T.StructField("__range", T.IntegerType())])
    return spark.read.schema(schema).parquet(path), path


def positions(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``position`` (from 1) of each row among those equal in ``by``, the first columns of the order, and ``total``,
    their number. Only counts per range and group are added up."""
    per = placed.groupBy(*by, "__range").agg(F.count("*").alias("__count"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(*by)
    before = F.sum("__count").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    of = {c: f"__of_{c}" for c in by}
    base = per.select(*(F.col(c).alias(n) for c, n in of.items()), F.col("__range").alias("__in"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__base"), F.sum("__count").over(whole).alias("total"))
    on = F.col("__range") == F.col("__in")
    for c, n in of.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    met = placed.join(base, on).drop("__in", *of.values())
    return met.withColumn("position", F.col("__at") + F.col("__base")).drop("__range", "__at", "__base")


def list_pages(rows: DataFrame, by: Sequence[str], name: str, size: int = 1000, ranges: int | None = None) -> DataFrame:
    """by, page (from 1), names (at most ``size``, sorted) and total: a group's names over as many rows as they need. Null names are left out."""
    if size < 1:
        raise ValueError("a page holds a name at least")
    placed, _ = ranked(rows.where(F.col(name).isNotNull()).select(*by, name), [*by, name], ranges=ranges)
    put = positions(placed, by).withColumn("page", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))
    return put.groupBy(*by, "page").agg(F.sort_array(F.collect_list(F.struct("position", name))).alias("__l"), F.max("total").alias("total")).select(*by, "page", F.transform("__l", lambda x: x[name]).alias("names"), "total")


@dataclass(frozen=True)
class Pages:
    """A sorted table at ``path`` with, per range, its number of rows and its first key: what finds a page without reading
    the rest. ``index`` has a row a range, so it is as long as the table has RANGE_ROWS."""

    path: str
    order: tuple[str, ...]
    schema: T.StructType
    index: tuple[tuple, ...]  # (range, rows, first key)

    def _read(self, spark: SparkSession, wanted: list[int]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path).where(F.col("__range").isin(wanted))

    def _columns(self) -> list[str]:
        return [f.name for f in self.schema if not f.name.startswith("__")]

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1), read from the ranges that hold it."""
        if number < 1 or not 1 <= size <= 100:
            raise ValueError("page from 1, size in 1..100")
        low, high = (number - 1) * size, number * size
        wanted, keep, start = [], F.lit(False), 0
        for part, rows, _ in self.index:
            if start < high and start + rows > low:
                wanted.append(part)
                keep = keep | ((F.col("__range") == part) & F.col("__at").between(low - start, high - start - 1))
            start += rows
        return self._read(spark, wanted).where(keep).orderBy("__range", "__at").select(*self._columns())

    def after(self, spark: SparkSession, key: tuple, size: int) -> DataFrame:
        """The ``size`` rows that follow a key, such as a page's last; the key's own rows are not among them."""
        if not 1 <= size <= 100 or len(key) != len(self.order):
            raise ValueError("a whole key, and size in 1..100")
        wanted, rest = [], size
        for i, (part, rows, _) in enumerate(self.index):
            following = self.index[i + 1][2] if i + 1 < len(self.index) else None
            if following is not None and _before(following, key):
                continue  # the next range begins at or before the key, so this one has nothing after it
            wanted.append(part)
            rest -= rows if wanted[0] != part else 0
            if rest <= 0:
                break
        return self._read(spark, wanted).where(_after(self.order, key)).orderBy("__range", "__at").limit(size).select(*self._columns())


def _before(a: tuple, b: tuple) -> bool:
    """Whether a < b or a = b, null first and texts by their UTF-8, as Spark sorts."""
    plain = lambda k: [(x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0) for x in k]
    return plain(a) <= plain(b)


def _after(order: Sequence[str], key: tuple) -> Column:
    """The rows whose key is larger: by the first column that differs."""
    out, same = F.lit(False), F.lit(True)
    for c, v in zip(order, key, strict=True):
        larger = F.col(c).isNotNull() if v is None else F.col(c) > F.lit(v)
        out = out | (same & F.coalesce(larger, F.lit(False)))
        same = same & F.col(c).eqNullSafe(F.lit(v))
    return out


def pages(rows: DataFrame, order: Sequence[str], path: str | None = None, ranges: int | None = None) -> Pages:
    """Writes the sorted table and gives its index."""
    placed, path = ranked(rows, order, path, ranges)
    per = placed.groupBy("__range").agg(F.count("*").alias("n"), F.min_by(F.struct(*order), "__at").alias("first")).orderBy("__range")
    index = tuple((r["__range"], r["n"], tuple(r["first"])) for r in per.collect())  # a row a range
    return Pages(path, tuple(order), placed.schema, index)
