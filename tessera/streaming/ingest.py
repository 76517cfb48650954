"""Ingestion as a stream: documents become chunks, and a document that comes again replaces its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.chunk import chunk_simple
from tessera.sources.buckets import Buckets
from tessera.sources.shared import written


def _table(spark: SparkSession, sink: str, docs_schema: StructType, key: str, buckets: int) -> Buckets:
    kind = docs_schema[key].dataType.simpleString()
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs_schema if f.name not in (key, "text"))
    shape = f"`{key}` {kind}, " + (others + ", " if others else "") + "chunk_index int, content string, token_count bigint, chunk_hash string"
    return Buckets(spark, sink, shape, key, buckets=buckets)


def chunk_stream(docs: DataFrame, sink: str, checkpoint: str, key: str = "doc_id", version: str | None = None, size: int = 512, overlap: int = 50, buckets: int = 64) -> StreamingQuery:
    """Chunks a stream of documents into a table of hash buckets, of which a batch rewrites those that hold one of its
    documents: the chunks of a document that comes again take the old ones' place, and a batch that is run again
    gives the same table. Of a document's rows in one batch that with the largest ``version`` counts or, without that
    column, with the largest text. Rows without a key are left out."""

    def write(batch: DataFrame, number: int) -> None:
        order = [F.desc(version)] if version else []
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*order, F.desc("text")))
        newest = written(batch.where(F.col(key).isNotNull()).withColumn("__nth", nth).where("__nth = 1").drop("__nth"), "newest")
        _table(batch.sparkSession, sink, docs.schema, key, buckets).replace(chunk_simple(newest, size=size, overlap=overlap), newest.select(key))

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, sink: str, key: str = "doc_id") -> DataFrame:
    """The chunks in a stream's table."""
    return spark.read.parquet(sink).where("live").drop("live", "bucket")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type with a watermark; the same on a batch and on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
