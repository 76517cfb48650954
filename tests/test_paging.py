"""Positions, list pages, deep pages and bucketed joins against plain sorting, and what the plans read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import paging as P
from tessera.operators import sync as Y
from tessera.sources import bucketed


@pytest.fixture(scope="module")
def names():
    random.seed(4)
    rows = [("hot" if i % 3 else random.choice(["a", "b", None]), random.choice([f"n{i}", "same", "é", "Z", "z"])) for i in range(700)]
    return rows + [("a", None), ("lone", "x"), (None, None)]


def test_list_over_pages(spark, names):
    df = spark.createDataFrame(names, "g string, name string").repartition(5)
    got = {}
    for r in P.list_pages(df, ["g"], "name", 100, ranges=7).collect():
        assert len(r.names) <= 100
        got.setdefault(r.g, {})[r.page] = (r.names, r.total)
    for g in {g for g, n in names if n is not None}:
        want = sorted((n for x, n in names if x == g and n is not None), key=str.encode)
        assert [n for page in sorted(got[g]) for n in got[g][page][0]] == want and sorted(got[g]) == list(range(1, len(got[g]) + 1))
        assert {t for _, t in got[g].values()} == {len(want)} and all(len(got[g][p][0]) == 100 for p in sorted(got[g])[:-1])
    assert len(got["hot"]) >= 3
    assert P.list_pages(df.where("false"), ["g"], "name").count() == 0
    with pytest.raises(ValueError):
        P.list_pages(df, ["g"], "name", 0)


def test_copies_fill_more_than_one_range(spark):
    df = spark.createDataFrame([("g", "same", i) for i in range(4000)], "g string, name string, i int")
    placed, _ = P.ranked(df, ["g", "name"], ranges=8)
    sizes = [r["count"] for r in placed.groupBy("__range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_pages_read_only_their_ranges(spark, names):
    rows = [(g, n, i) for i, (g, n) in enumerate(names)]
    df = spark.createDataFrame(rows, "g string, name string, i int").repartition(4)
    held = P.pages(df, ["g", "name", "i"], ranges=9)
    order = sorted(rows, key=lambda r: tuple((x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0) for x in r))
    for size in (1, 7, 100):
        for number in {1, 2, 5, len(rows) // size, len(rows) // size + 1, len(rows) // size + 2}:
            page = held.page(spark, number, size)
            assert [tuple(r) for r in page.collect()] == order[(number - 1) * size : number * size]
            plan = page._jdf.queryExecution().executedPlan().toString()
            if (number - 1) * size < len(rows):
                assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters: [")[1][:60]
    for key in (order[0], order[333], order[-1], (None, None, -1), ("a", "nothing such", 0), ("zz", "", 0)):
        at = [r for r in order if tuple((x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0) for x in r) > tuple((x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0) for x in key)]
        assert [tuple(r) for r in held.after(spark, key, 20).collect()] == at[:20]
    for call in (lambda: held.page(spark, 0, 5), lambda: held.page(spark, 1, 101), lambda: held.after(spark, ("a",), 5)):
        with pytest.raises(ValueError):
            call()
    none = P.pages(df.where("false"), ["g", "name", "i"])
    assert none.page(spark, 1, 10).count() == 0 and none.after(spark, ("a", "b", 1), 10).count() == 0


def test_a_deep_page_opens_one_or_two_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    held = P.pages(df, ["k"], ranges=20)
    page = held.page(spark, 45, 100)
    scanned = page._jdf.queryExecution().executedPlan().toString()
    wanted = scanned.split("__range")[1]
    assert [r.k for r in page.collect()] == list(range(4400, 4500)) and wanted.count(",") <= 4


def test_bucketed_plan_shuffles_the_snapshot_only(spark):
    shape = "tenant_slug string, file_path string, file_hash string, file_size long, sync_status string"
    old = spark.createDataFrame([("a", f"p{i}", "x", 1, "synced") for i in range(50)], shape)
    now = spark.createDataFrame([("a", f"p{i}", "x" if i % 3 else "y", 1, "synced") for i in range(5, 60)], shape)
    tables = [f"bucketed_{os.getpid()}_{n}" for n in "rs"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        registry = bucketed.save(old, tables[0], Y.KEY, 8)
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        planned = Y.plan(now, registry)
        assert exchanges(planned) == 1 and exchanges(Y.plan(now, old)) == 2
        both = Y.plan(bucketed.save(now, tables[1], Y.KEY, 8), registry)
        assert exchanges(both) == 0
        rows = lambda df: sorted((r.file_path, r.change) for r in df.collect())
        assert rows(planned) == rows(both) == rows(Y.plan(now, old))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")
