"""Tables bucketed by their key, so that a join on it does not shuffle them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def save(rows: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Writes ``rows`` as a table of ``buckets`` buckets, sorted within each, and reads it. Take at least as many buckets as
    ``spark.sql.shuffle.partitions``: of fewer Spark makes more by shuffling both sides. A catalog keeps the
    bucketing, so the table is found by its name in later sessions that share it. Rows are dealt to their bucket first, so
    that each is one file."""
    writer = rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(table)
    return rows.sparkSession.table(table)
