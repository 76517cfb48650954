"""The inverted file against the exact search."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ivf
from tessera.operators import search as S
from tests.conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return ivf.build(vectors, str(tmp_path_factory.mktemp("ivf")), lists=12)


def asked(vectors, *more):
    return vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), *more)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.distance) for r in df.collect())


def test_all_lists_give_the_exact_result(vectors, index):
    assert rows(index.search(asked(vectors), 5, 12)) == rows(S.knn_batch(vectors, asked(vectors), 5))
    assert rows(index.search(asked(vectors, "label"), 5, 12, ["label"])) == rows(S.knn_batch(vectors, asked(vectors, "label"), 5, ["label"]))


def test_recall_grows_with_probes_and_reaches_what_is_asked(vectors, index):
    exact = S.knn_batch(vectors, asked(vectors), 5).cache()
    some = [ivf.recall(index.search(asked(vectors), 5, p), exact) for p in (1, 4, 12)]
    assert some[0] < some[1] < some[2] == 1.0
    probes, got = index.probes_for(asked(vectors), 0.9)
    assert got >= 0.9 and ivf.recall(index.search(asked(vectors), 5, probes), exact) == pytest.approx(got)
    assert probes == 1 or probes <= 12


def test_groups_need_few_probes(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    data = [(i, [float(x) for x in centres[i % 20] + 0.05 * r.normal(size=16)]) for i in range(2000)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    index = ivf.build(v, str(tmp_path), lists=20, metric="euclidean")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    probes, got = index.probes_for(q, 0.95)
    assert probes <= 3 and got >= 0.95
    again = ivf.open_index(spark, str(tmp_path))
    assert rows(again.search(q, 3, 2)) == rows(index.search(q, 3, 2))


def test_only_probed_lists_are_read(vectors, index):
    one = asked(vectors).where("query_id = 0")
    plan = index.search(one, 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list#" in plan.replace("isnotnull(list", "list") or "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:80]


def test_every_row_is_kept_and_odd_rows_find_nothing(spark, tmp_path):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [None, 1.0]), (1, [1.0, 0.1]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("extra", F.lit("x"))
    index = ivf.build(v, str(tmp_path), lists=2)
    table = index.table(spark)
    assert table.count() == len(data) and table.where("list = -1").count() == 5 and "extra" in table.columns
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = S.knn_batch(v, q, 9).where("distance is not null and not isnan(distance)")
    got = index.search(q, 9, 2)
    assert {(r.query_id, r.vec_id, r.distance) for r in got.collect()} == {(r.query_id, r.vec_id, r.distance) for r in exact.collect() if r.query_id not in (3, 4, 5, 6, 7)}
    index.insert(spark.createDataFrame([(9, [1.0, 0.05], "y")], "vec_id long, embedding array<float>, extra string"))
    assert index.table(spark).count() == len(data) + 1
    assert 9 in {r.vec_id for r in index.search(q.where("query_id = 1"), 9, 2).collect()}
    none = ivf.build(v.where("false"), str(tmp_path / "none"))
    assert none.search(q, 3).count() == 0


def test_recall_of_the_registered_query(spark):
    """Every hundredth row against all, as ``knn_batch_hundredth`` has it exactly."""
    from tessera.plans.queries import QUERIES

    for sf in (SF, SF.replace("sf0.001", "sf0.01")):
        exact = QUERIES["knn_batch_hundredth"](spark, sf)
        found = QUERIES["knn_ivf"](spark, sf)
        assert found.count() == exact.count() and ivf.recall(found, exact) >= 0.9


def test_a_sample_fits_the_centres_and_every_row_is_listed(vectors, tmp_path):
    index = ivf.build(vectors, str(tmp_path), lists=6, sample=60)
    assert index.table(vectors.sparkSession).where("list >= 0").count() == vectors.where("embedding is not null").count()
    assert rows(index.search(asked(vectors), 5, 6)) == rows(S.knn_batch(vectors, asked(vectors), 5))


def test_refused_metric(vectors, tmp_path):
    with pytest.raises(ValueError, match="exactly"):
        ivf.build(vectors, str(tmp_path), metric="dot")
