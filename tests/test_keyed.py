"""The stream with keyed state against the batch plan."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sync as Y
from tessera.streaming import keyed as K

SHAPE = "tenant_slug string, file_path string, file_hash string, version long, deleted boolean"


@pytest.fixture
def stream(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def feed(df):
        df.select("tenant_slug", "file_path", "file_hash", "version", "deleted").coalesce(1).write.mode("append").parquet(source)
        K.change_stream(spark.readStream.schema(SHAPE).parquet(source), sink, mark).awaitTermination()
        return sorted((r.version, r.tenant_slug, r.file_path, r.change, r.file_hash) for r in spark.read.parquet(sink).collect())

    feed.sink = sink
    return feed


def snap(spark, files):
    rows = [(t, p, h, 1, "synced") for (t, p), h in files.items()]
    return spark.createDataFrame(rows, "tenant_slug string, file_path string, file_hash string, file_size long, sync_status string")


def test_three_snapshots_replayed_end_as_the_last_one(spark, stream):
    days = [
        {("a", "1"): "x", ("a", "2"): "x", ("b", "1"): "y", ("b", "9"): None},
        {("a", "1"): "x", ("a", "2"): "z", ("b", "3"): "n", ("b", "9"): "now"},
        {("a", "2"): "z", ("b", "1"): "y", ("b", "3"): "m", ("b", "9"): "now"},
    ]
    before, seen = snap(spark, {}), 0
    for number, files in enumerate(days, 1):
        now = snap(spark, files)
        changes = stream(K.observations(now, before, number))
        want = {(r.tenant_slug, r.file_path, r.change) for r in Y.plan(now, before).where("change <> 'unchanged'").collect()}
        assert {(t, p, c) for v, t, p, c, _ in changes if v == number} == want and len(changes) == seen + len(want)
        before, seen = now, len(changes)
    got = {(r.tenant_slug, r.file_path): r.file_hash for r in K.registry_of(spark, stream.sink).collect()}
    assert got == days[-1]
    # the same as a sync of the last snapshot from nothing
    whole = Y.sync(now.withColumn("text", F.lit("words enough to be a chunk")), snap(spark, {}), spark.createDataFrame([], "tenant_slug string, file_path string, chunk_index int, content string, token_count long, embedding array<float>"))
    assert {(r.tenant_slug, r.file_path): r.file_hash for r in whole.registry.collect()} == got


def test_late_repeated_and_broken_observations(spark, stream):
    rows = lambda *r: spark.createDataFrame(list(r), SHAPE)
    stream(rows(("a", "p", "h2", 2, False), ("a", "p", "h2", 2, None), (None, "p", "h", 1, False), ("a", None, "h", 1, False), ("a", "q", "h", None, False)))
    stream(rows(("a", "p", "h1", 1, False), ("a", "p", None, 2, True)))  # late: both give nothing
    assert stream(rows(("a", "p", None, 3, True), ("a", "p", "h5", 5, False), ("a", "p", "h4", 4, False))) == [
        (2, "a", "p", "new", "h2"), (3, "a", "p", "deleted", None), (4, "a", "p", "new", "h4"), (5, "a", "p", "updated", "h5"),
    ]
    stream(rows(("a", "gone", None, 9, True)))  # was never there
    assert {(r.file_path, r.file_hash, r.version) for r in K.registry_of(spark, stream.sink).collect()} == {("p", "h5", 5)}
