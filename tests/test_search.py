"""Batch search in tiles against the distances' own expressions on all pairs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import search as S
from tests.conftest import SF


def by_pairs(v, q, k, by, metric):
    """Each query's distance to every vector, then the first k."""
    pairs = v.join(q, list(by)) if by else v.crossJoin(q)
    d = F.round(S.DISTANCES[metric](F.col("embedding"), F.col("query_vector")), 6)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"))
    return pairs.select("query_id", "vec_id", d.alias("distance")).withColumn("rank", rank).where(F.col("rank") <= k)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, repr(r.distance if r.distance is None else r.distance + 0.0)) for r in df.collect())


@pytest.mark.parametrize("metric", sorted(S.DISTANCES))
@pytest.mark.parametrize("by", [(), ("label",)])
def test_tiles_are_whole(spark, monkeypatch, metric, by):
    monkeypatch.setattr(S, "ROWS", 90)
    monkeypatch.setattr(S, "QUERIES", 7)
    x = np.random.default_rng(4).normal(size=(900, 6))
    x[300:420] = x[0]  # ties by id, over several tiles
    x[500:520] = x[100] + 1e-7
    x[7] = 0
    odd = [(1000, None), (1100, [1.0, None] + [0.0] * 4), (1200, [0.5] * 3), (1300, []), (1400, [float("nan")] * 6)]
    data = [(i, [float(c) for c in r], i % 3) for i, r in enumerate(x)] + [(i, r, 1) for i, r in odd] + [(1500, [1.0] * 6, None), (1600, [2.0] * 3, 9)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3).cache()
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), *by)
    got = S.knn_batch(v, q, 5, by, metric)
    assert rows(got) == rows(by_pairs(v, q, 5, by, metric))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert S.knn_batch(v.where("false"), q, 5, by, metric).count() == 0


def test_inventory_counts_all_files(spark):
    from tessera.plans import queries as P
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.tenant_inventory_all(spark, SF).agg(F.sum("n_files")).first()[0] == docs.where("source is not null").count()


def test_thresholds_by_metric(spark):
    from tessera.operators import retrieve as R
    from tessera.operators import tenants as N

    rows = [("a", i, 0, f"text {i}", 2, v) for i, v in enumerate([[2.0, 0.0], [0.5, 0.0], [-1.0, 0.0]])]
    chunks = spark.createDataFrame(rows, "tenant_slug string, file_id long, chunk_index int, content string, token_count long, embedding array<float>")
    files = chunks.select("tenant_slug", "file_id", F.lit("n").alias("filename"))
    asked = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, tenant_slug string, query_vector array<float>")
    chunks = chunks.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 382)))
    asked = asked.withColumn("query_vector", F.concat("query_vector", F.array_repeat(F.lit(0.0).cast("float"), 382)))
    found = lambda metric, threshold: {r.file_id: r.score for r in R.search_batch(chunks, asked, files, R.SearchConfig(metric=metric, threshold=threshold)).collect()}
    assert found("dot", 0.9) == {0: 1.0} and found("dot", -1.0) == {0: 1.0, 1: 0.5, 2: 0.0} and found("dot", 1.5) == {0: 1.0}
    assert found("euclidean", 0.5) == {0: 0.5, 1: 0.666667} and found("euclidean", 0.3) == {0: 0.5, 1: 0.666667, 2: 0.333333}
    assert found("cosine", 0.9) == {0: 1.0, 1: 1.0}
    with pytest.raises(ValueError):
        R.SearchConfig(threshold=1.5)
    R.SearchConfig(metric="dot", threshold=1.5)
    other = chunks.withColumn("embedding_model", F.when(F.col("file_id") == 0, "all-MiniLM-L6-v2").otherwise("a model of the same length"))
    assert {r.file_id for r in R.search_batch(other, asked, files).collect()} == {0}
    assert N.TenantView("a").of(other).count() == 3


def test_the_corpus_is_embedded_once(spark, monkeypatch):
    from tessera.operators import embed as E
    from tessera.plans import queries as Q

    passes = []
    real = E.embed
    monkeypatch.setattr(E, "embed", lambda df, *a, **k: passes.append(k.get("text_col", "content")) or real(df, *a, **k))
    Q.run_overlap(spark, SF)
    assert passes.count("content") == 1
    plan = Q.semantic_search(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
