"""Vectors by content: each distinct text is embedded once per model, whatever files and tenants hold it.

The key is (model, SHA-256 of the text). A text whose key is there is not sent to the model again. Two writers that add
the same text at the same time add equal rows; readers take one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import MODELS
from tessera.operators.embed import embed

SHAPE = "chunk_hash string, embedding array<float>, model string"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _of(self, model: str) -> DataFrame:
        if model not in MODELS:
            raise ValueError(f"unknown model {model}")
        if not self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return self.spark.createDataFrame([], SHAPE)
        return self.spark.read.schema(SHAPE).parquet(self.path).where(F.col("model") == model)

    def add(self, texts: DataFrame, model: str) -> int:
        """Embeds the texts (chunk_hash, content) that are not there yet and gives their number, counted as they are written."""
        distinct = texts.where("chunk_hash is not null").groupBy("chunk_hash").agg(F.first("content").alias("content"))
        fresh = distinct.join(self._of(model).select("chunk_hash"), "chunk_hash", "left_anti")
        seen = Observation()
        made = embed(fresh, model).observe(seen, F.count(F.lit(1)).alias("n"))
        made.select("chunk_hash", "embedding", F.lit(model).alias("model")).write.mode("append").partitionBy("model").parquet(self.path)
        return seen.get["n"]

    def joined(self, pieces: DataFrame, model: str) -> DataFrame:
        """``pieces`` with their text's vector as ``embedding`` and ``embedding_model``. Only the vectors asked for are shuffled."""
        asked = pieces.select("chunk_hash").distinct()
        held = self._of(model).join(asked, "chunk_hash", "left_semi").groupBy("chunk_hash").agg(F.first("embedding").alias("embedding"))
        return pieces.join(held, "chunk_hash").withColumn("embedding_model", F.lit(model))
