"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str = "t") -> str:
    """A new folder's name under spark.checkpoint.dir. Only a local master gets a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a written table, so that later steps read it and compute nothing again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
