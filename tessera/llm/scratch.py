"""Intermediate tables in the folder that driver and executors share.

``stash`` cuts lineage by writing Parquet under ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs a retry of tasks and never a recomputation of the whole job. ``drop`` deletes what
no later step reads."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_tables: dict[str, str] = {}  # registered tables by their folder


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Only a local master, as in tests, gets a temporary folder where that
    is unset; on a cluster that would be the driver's own disk, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str = "t", by: str | None = None, **seen: str) -> DataFrame:
    """``by``: the table is bucketed by that column, so a later join on it does not shuffle this side. ``seen``: aggregates, as SQL,
    taken while the rows are written, so that asking for them later is no job; the result's ``seen`` has them by name."""
    spark, watch = df.sparkSession, Observation()
    if seen:
        df = df.observe(watch, *(F.expr(e).alias(n) for n, e in seen.items()))
    path = f"{shared_dir(spark)}-{name}"
    if by:
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(partitions(spark), by).sortBy(by).option("path", path).format("parquet").saveAsTable(table)
        _tables[path.rsplit("/", 1)[-1]] = table
        out = spark.table(table)
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    # The written job's shuffle files go once the driver has collected its plan; nothing else makes it do so in time.
    spark.sparkContext._jvm.System.gc()
    out.stashed, out.seen = path, watch.get if seen else {}
    return out


def drop(*stashed: DataFrame) -> None:
    """Deletes the folders (and the table names) of data frames that ``stash`` gave back."""
    for df in stashed:
        _delete(df.sparkSession, df.stashed)


def drop_unheld(stashed: DataFrame) -> None:
    """``drop`` once nothing holds this data frame itself any more; what was derived from it is no longer to be read then."""
    weakref.finalize(stashed, _delete, stashed.sparkSession, stashed.stashed).atexit = False


def _delete(spark: SparkSession, path: str) -> None:
    table = _tables.pop(path.rsplit("/", 1)[-1], None)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
