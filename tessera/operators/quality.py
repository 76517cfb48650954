"""The tables' checks as a gate: rows with the rules they break go to quarantine, the others go on.

A check that compares with null is not broken, as in SQL; that a column must not be null is a rule of its own."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators.runlog import OPERATIONS
from tessera.operators.runlog import STATUSES as RUN_STATUSES
from tessera.operators.sync import STATUSES
from tessera.sources.shared import shared_folder

#: What must hold of a row, by table, as (column, rule, test), and the columns that must not be null.
CHECKS = {
    "files": [("file_size", "file_size_positive", lambda c: c > 0), ("sync_status", "sync_status_known", lambda c: c.isin(*STATUSES))],
    "chunks": [("chunk_index", "chunk_index_non_negative", lambda c: c >= 0), ("token_count", "token_count_positive", lambda c: c > 0)],
    "runs": [
        ("operation_type", "operation_type_known", lambda c: c.isin(*OPERATIONS)),
        ("status", "status_known", lambda c: c.isin(*RUN_STATUSES)),
        ("progress_percentage", "progress_in_range", lambda c: c.between(0, 100)),
        ("current_file_index", "current_file_index_non_negative", lambda c: c >= 0),
        ("total_files_to_process", "total_files_non_negative", lambda c: c >= 0),
    ],
}
REQUIRED = {"files": ("tenant_slug", "file_path", "file_hash"), "chunks": ("tenant_slug", "chunk_index", "content"), "runs": ("tenant_slug", "operation_type")}


class Gate(NamedTuple):
    """Rows that go on, rows in quarantine with ``broken``, and how many rows broke each rule."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def rules(table: str, columns: list[str]) -> dict[str, Column]:
    """The rules of a table that its columns allow to be checked, each as what must hold."""
    out = {rule: test(F.col(c)) for c, rule, test in CHECKS[table] if c in columns}
    return out | {f"{c}_present": F.col(c).isNotNull() for c in REQUIRED[table] if c in columns}


def marked(rows: DataFrame, table: str, unique: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``broken``, the names of the rules they break, in order. With ``unique`` the rows of a key but for its
    first, in the order of all columns, break key_repeated."""
    held = rules(table, rows.columns)
    names = [F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in held.items()]
    if unique:
        whole = F.lit(True)
        for c in unique:
            whole = whole & F.col(c).isNotNull()
        spread = [F.when(whole, F.lit(0)).otherwise(F.xxhash64(*rows.columns))]  # rows without a key are not one group
        nth = F.row_number().over(Window.partitionBy(*unique, *spread).orderBy(*[c for c in rows.columns if c not in unique]))
        rows = rows.withColumn("__nth", nth)
        names.append(F.when(whole & (F.col("__nth") > 1), F.lit("key_repeated")))
    return rows.withColumn("broken", F.array_compact(F.array(*names))).drop("__nth")


def gate(rows: DataFrame, table: str, unique: tuple[str, ...] = (), folder: str | None = None) -> Gate:
    """Writes good and bad rows in one pass, in which the broken rules are counted too. ``folder`` keeps them; otherwise
    they go to the shared folder."""
    spark = rows.sparkSession
    seen = Observation()
    split = marked(rows, table, unique)
    every = [*rules(table, rows.columns), *(["key_repeated"] if unique else [])]
    counted = split.observe(seen, *(F.count_if(F.array_contains("broken", n)).alias(n) for n in every), F.count_if(F.size("broken") > 0).alias("__rows"))
    path = folder or shared_folder(spark, "gate")
    counted.withColumn("kept", F.size("broken") == 0).write.mode("overwrite").partitionBy("kept").parquet(path)
    out = spark.read.schema(split.withColumn("kept", F.lit(True)).schema).parquet(path)
    return Gate(out.where("kept").drop("kept", "broken"), out.where("not kept").drop("kept"), dict(seen.get))
