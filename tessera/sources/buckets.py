"""Parquet tables in folders by tenant and hash bucket of a key, of which an update rewrites only the buckets it touches.

An update is a dynamic partition overwrite: it reads a touched bucket's other keys, puts the new rows beside them and swaps
the bucket's folder when all tasks are done. A bucket that loses its last key keeps one row that is not live, so that its
folder is swapped as well. Replacing a key twice by the same rows gives the same table, so an update that broke off is
simply run again. One writer at a time: see ``lease``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import hadoop


class Buckets:
    """The table at ``path``; ``by`` are partition columns before the bucket, of which an update names one value each.

    ``buckets`` holds for the table's life: take as many as the table has GB, so that a touched one is rewritten in
    seconds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, by: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.by = spark, path, key, tuple(by)
        fields = T._parse_datatype_string(schema).fields
        self.schema = T.StructType([f for f in fields if f.name not in self.by] + [T.StructField("live", T.BooleanType())] + [f for f in fields if f.name in self.by] + [T.StructField("bucket", T.IntegerType())])
        self.columns = [f.name for f in fields]
        mark = f"{path}/_buckets"
        if not hadoop.create_new(spark, mark, str(buckets)):
            kept = hadoop.read_text(spark, mark)
            if kept and int(kept) != buckets:
                raise ValueError(f"{path} has {kept} buckets, not {buckets}")
        self.buckets = buckets

    def bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._raw().where("live").select(*self.columns)

    def replace(self, fresh: DataFrame, keys: DataFrame, at: dict[str, str] | None = None) -> int:
        """Of the ``keys`` all rows go and the ``fresh`` rows come; gives the number of buckets rewritten. Both should be
        written tables, since they are read twice. ``at``: the value of each column of ``by``."""
        at = at or {}
        if set(at) != set(self.by):
            raise ValueError(f"an update names {self.by}")
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        touched = [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return 0
        here = self._raw().where(F.col("bucket").isin(touched))
        for c, v in at.items():
            here, fresh = here.where(F.col(c) == v), fresh.withColumn(c, F.lit(v))
        stay = here.where("live").join(keys, self.key, "left_anti").select(*self.schema.names)
        come = fresh.where(F.col(self.key).isNotNull()).withColumns({"live": F.lit(True), "bucket": self.bucket()}).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket int").withColumns({c: F.lit(v) for c, v in at.items()} | {"live": F.lit(False)})
        rows = stay.unionByName(come).unionByName(empty.select(*(F.col(f.name) if f.name in empty.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema)))
        rows.repartition(len(touched), "bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*self.by, "bucket").parquet(self.path)
        self.spark.catalog.refreshByPath(self.path)
        return len(touched)
