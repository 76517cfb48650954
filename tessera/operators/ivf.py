"""Approximate nearest neighbours by an inverted file: lists of vectors around k-means centres, of which a search reads the nearest.

The centres are fitted on a sample whose size is set (of a larger table each row is drawn with the chance that gives ``SAMPLE`` rows on average); every row of the table is
then put into the list of its nearest centre. The index is a Parquet table partitioned by list, so a search reads only
the folders of the lists that its queries probe. Distances to what is read are those of ``search.knn_batch``, rounding
and ties included: with all lists probed the results are equal, and ``knn_batch`` stays the exact way.

Rows whose vector is null, holds null or non-finite components, is zero under the cosine metric, or has another length
than the centres go to list -1, which no search reads: they have no distance. Queries like that find nothing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import search as S

SAMPLE = 100_000  # rows that the centres are fitted on, about
MOST_LISTS = 4096  # bounds what a search sends to each task
ASKED = 256  # queries that probes are chosen on
METRICS = ("cosine", "euclidean")


def _usable(vector: Column, metric: str, width: int | None = None) -> Column:
    v = vector.cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    fine = fine & (F.size(v) == width) if width is not None else fine
    return F.coalesce(fine & F.exists(v, lambda x: x != 0) if metric == "cosine" else fine, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _probed(centres: np.ndarray, metric: str, n: int):
    """For mapInArrow: (usable, vector, ...) -> the row with its n nearest lists; list -1 where it is not usable."""

    def run(batches):
        for batch in batches:
            fine = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            out = np.full((batch.num_rows, n), -1, np.int32)
            good = np.flatnonzero(fine)
            for lo in range(0, len(good), 4096):
                at = good[lo : lo + 4096]
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
                if metric == "cosine":
                    x = _unit(x)
                far = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
                out[at] = np.argsort(far, axis=1, kind="stable")[:, :n]
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * n
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], [*batch.schema.names[1:], "__lists"])

    return run


@dataclass(frozen=True)
class IvfIndex:
    """An index at ``path``: its centres, metric, the names of its columns, and its rows' schema."""

    path: str
    centres: np.ndarray
    metric: str
    id_col: str
    vector_col: str
    schema: T.StructType

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _listed(self, rows: DataFrame, vector_col: str, n: int) -> DataFrame:
        fine = _usable(F.col(vector_col), self.metric, self.centres.shape[1])
        others = [c for c in rows.columns if c != vector_col]
        shaped = rows.select(fine.alias("__fine"), F.col(vector_col).cast("array<double>").alias(vector_col), *others)
        kinds = T.StructType([*shaped.schema.fields[1:], T.StructField("__lists", T.ArrayType(T.IntegerType()))])
        return shaped.mapInArrow(_probed(self.centres, self.metric, n), kinds)

    def insert(self, vectors: DataFrame) -> None:
        """Adds rows to the lists of the centres that are there. A list larger than a block is written by several tasks."""
        listed = self._listed(vectors, self.vector_col, 1).withColumn("list", F.get("__lists", F.lit(0))).drop("__lists")
        part = F.pmod(F.xxhash64(self.id_col), F.lit(8))
        listed.select(*self.schema.names).repartition("list", part).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def sizes(self, spark: SparkSession) -> DataFrame:
        """(list, n), one row a list that holds rows."""
        return self.table(spark).groupBy("list").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
        """(query_id, id, distance, rank) of the k nearest rows in each query's ``probes`` nearest lists.

        queries: query_id, query_vector, *by; ``by`` names columns that a query shares with its rows, and filters before
        the ranking. A list's rows and queries meet in tiles, as in ``knn_batch``, so that a list that holds a third of all
        rows is spread over tasks."""
        spark = queries.sparkSession
        for c in by:
            queries = queries.where(F.col(c).isNotNull())
        asked = self._listed(queries.select("query_id", "query_vector", *by), "query_vector", min(probes, len(self.centres)))
        asked = asked.select("query_id", F.col("query_vector").alias("__q"), *by, F.explode(F.array_distinct("__lists")).alias("list")).where("list >= 0")
        per = asked.groupBy("list").agg(F.count("*").alias("asks"))
        wanted = [r["list"] for r in per.select("list").collect()]  # at most MOST_LISTS numbers; makes partition filters of them
        rows = self.table(spark).where(F.col("list").isin(wanted))
        deal = rows.groupBy("list").agg(F.count("*").alias("n")).join(per, "list").select("list", *(F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int").alias(out) for c, size, out in (("n", S.ROWS, "__blocks"), ("asks", S.QUERIES, "__asks"))))
        deal = F.broadcast(deal)  # a row a list, MOST_LISTS at most
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = rows.join(deal, "list").select(*by, "list", F.pmod(F.xxhash64(self.id_col, self.vector_col), "__blocks").cast("int").alias("__block"), every("__asks").alias("__ask"), F.col(self.id_col).alias("__id"), F.col(self.vector_col).alias("__v"))
        right = asked.join(deal, "list").select(*by, "list", every("__blocks").alias("__block"), F.pmod(F.xxhash64("query_id", "__q"), "__asks").cast("int").alias("__ask"), F.col("query_id").alias("__query"), "__q")
        on = [*by, "list", "__block", "__ask"]
        kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(self.id_col, rows.schema[self.id_col].dataType), T.StructField("distance", T.DoubleType())])
        won = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(S._tile(k, self.metric, digits, kinds.names), kinds)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), self.id_col))
        return won.where("distance is not null").withColumn("rank", rank).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, want: float = 0.9, k: int = 5, most: int = ASKED) -> tuple[int, float]:
        """The fewest lists whose recall reaches ``want``, with that recall, measured on the ``most`` queries with the smallest
        hashed ids against the exact search over all rows. A true neighbour is found when its list is probed, so the
        place of its list in the query's order of lists tells how many probes it needs; no search is tried out."""
        spark = queries.sparkSession
        some = queries.select("query_id", "query_vector").orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        some = spark.createDataFrame(some.collect(), some.schema)  # bounded by ``most``
        rows = self.table(spark).where("list >= 0").select(self.id_col, self.vector_col, "list")
        exact = S.knn_batch(rows, some, k, metric=self.metric, id_col=self.id_col, vector_col=self.vector_col).select("query_id", self.id_col)
        order = self._listed(some, "query_vector", len(self.centres)).select("query_id", "__lists")
        place = F.array_position("__lists", F.col("list"))
        needs = exact.join(rows.select(self.id_col, "list"), self.id_col).join(order, "query_id").groupBy("query_id", self.id_col).agg(F.min(place).alias("needs"))
        per = sorted((r["needs"], r["n"]) for r in needs.groupBy("needs").agg(F.count("*").alias("n")).collect())  # a row a list at most
        total, got, probes = sum(n for _, n in per), 0, 1
        for probes, n in per:
            got += n
            if got >= want * total:
                break
        return int(probes), got / total if total else 1.0


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """The share of the exact neighbours that were found; 1 where there are none."""
    both = exact.select("query_id", id_col).join(found.select("query_id", id_col).withColumn("hit", F.lit(1)), ["query_id", id_col], "left")
    n, hits = both.agg(F.count("*"), F.coalesce(F.sum("hit"), F.lit(0))).first()
    return hits / n if n else 1.0


def build(vectors: DataFrame, path: str, lists: int | None = None, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rounds: int = 15) -> IvfIndex:
    """Fits the centres, writes every row under ``path`` and gives the index. Without ``lists`` there are as many as the
    square root of the rows, MOST_LISTS at most."""
    if metric not in METRICS:
        raise ValueError(f"an index serves {METRICS}; search {metric} exactly")
    spark = vectors.sparkSession
    fine = vectors.where(_usable(F.col(vector_col), metric))
    widest = fine.groupBy(F.size(vector_col).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width, n = (widest[0]["width"], widest[0]["count"]) if widest else (0, 0)
    lists = min(lists or max(1, round(n**0.5)), MOST_LISTS)
    centres = np.zeros((1, width))
    if n:
        some = fine.where(F.size(vector_col) == width)
        some = some.sample(sample / n, seed=7) if n > sample else some  # drawn where the rows are: no task gathers the sample
        points = some.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")).repartition(spark.sparkContext.defaultParallelism).cache()
        model = KMeans(k=lists, maxIter=rounds, seed=7, distanceMeasure=metric, initMode="k-means||").fit(points) if lists > 1 else None
        centres = np.array(model.clusterCenters()) if model else np.zeros((1, width))
        points.unpersist()
    kinds = [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == vector_col else f.dataType) for f in vectors.schema]
    schema = T.StructType([*kinds, T.StructField("list", T.IntegerType())])
    index = IvfIndex(path, _unit(centres) if metric == "cosine" else centres, metric, id_col, vector_col, schema)
    meta = [(i, [float(x) for x in c], metric, id_col, vector_col, schema.json()) for i, c in enumerate(index.centres)]
    spark.createDataFrame(meta, "list int, centre array<double>, metric string, id_col string, vector_col string, shape string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    index.insert(vectors)
    return index


def open_index(spark: SparkSession, path: str) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # MOST_LISTS at most
    return IvfIndex(path, np.array([r["centre"] for r in rows]), rows[0]["metric"], rows[0]["id_col"], rows[0]["vector_col"], T.StructType.fromJson(json.loads(rows[0]["shape"])))
