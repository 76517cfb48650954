"""Rows told apart where their ids are not: numbers in the order of (id, text's hash)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import partitions, stash


def repeats_ids(texts: DataFrame) -> bool:
    """Whether an id stands in more than one row. Reads the ids alone."""
    return texts.groupBy("id").count().where("count > 1").limit(1).count() > 0


def numbered(texts: DataFrame) -> DataFrame:
    """(id, text) -> a stashed table (key, id, same, text) with one row for each id and text. Keys rise with the id, and ``same``
    (xxhash64 of the text) decides between rows of one id, so that results do not depend on the rows' order. A range
    partitioning deals rows of one id over tasks by their texts."""
    rows = texts.withColumn("same", F.xxhash64("text")).dropDuplicates(["id", "same"])
    dealt = rows.repartitionByRange(partitions(texts.sparkSession), "id", "same").sortWithinPartitions("id", "same")
    return stash(dealt.select(F.monotonically_increasing_id().alias("key"), "id", "same", "text"), "numbered")
