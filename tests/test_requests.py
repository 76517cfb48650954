"""Ranges of requests, ids and times from outside, settings written back, one row or none."""

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids as I
from tessera.functions import text as X
from tessera.operators import requests as R
from tessera.operators import stats as A
from tessera.operators import tenants as N
from tessera.sources import files as S


@pytest.mark.parametrize("name", sorted(R.RANGES))
def test_ranges(name):
    least, most = R.RANGES[name]
    of = (lambda n: "x" * n) if name in ("query", "key_name", "description") else (lambda n: ["q"] * n) if name == "queries" else (lambda n: n)
    assert R.within(name, of(least)) == of(least)
    if most is not None:
        assert R.within(name, of(most)) == of(most)
    for bad in ([of(least - 1)] if least > 0 or name not in ("description",) else []) + ([of(most + 1)] if most is not None else []) + [None, True]:
        with pytest.raises(ValueError, match=name):
            R.within(name, bad)


def test_whole_requests():
    assert R.SyncRequest(100, 0).config().size == 100
    for bad in ({"chunk_size": 99}, {"chunk_size": 2001}, {"chunk_overlap": 501}, {"chunk_size": 100, "chunk_overlap": 100}, {"sync_interval": 0}, {"model": "odd"}, {"strategy": "odd"}):
        with pytest.raises(ValueError):
            R.SyncRequest(**bad)
    assert R.BatchRequest(["what?"] * 10, 3, 0.25).config().k == 3
    for bad in (([],), (["q"] * 11,), ([" "],), (["q"], 0), (["q"], 21), (["q"], 5, 1.5), (["q" * 2001],)):
        with pytest.raises(ValueError):
            R.BatchRequest(*bad)


def test_ids_and_times(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, ""), (None, "1a"), (1, "a")], "n long, s string")
    got = [r.u for r in df.select(I.row_uuid(F.col("n"), F.col("s")).alias("u")).collect()]
    assert got[0] == got[4] and len(set(got)) == 4
    assert all(str(uuid.UUID(u)) == u and uuid.UUID(u).version == 3 and uuid.UUID(u).variant == uuid.RFC_4122 for u in got)
    assert I.new_key("a", lambda n: "0" * 2 * n) == "tenant_a_" + "0" * 40 and len(I.new_key("a")) == len(I.new_key("b")) and I.new_key("a") != I.new_key("a")
    at, later = datetime(2024, 1, 1), datetime(2024, 2, 2)
    first = I.stamped(df, at)
    again = I.stamped(first, later)
    assert {(r.created_at, r.updated_at) for r in again.collect()} == {(at, later)}


def test_maps(spark):
    row = spark.sql("select map('a', '1', 'b', '2') as x, map('b', '3', 'c', null) as y, cast(null as map<string,string>) as z")
    got = row.select(X.merged(F.col("x"), F.col("y")).alias("xy"), X.merged(F.col("z"), F.col("x")).alias("zx"), X.merged(F.col("x"), F.col("z")).alias("xz"), X.merged(F.col("z"), F.col("z")).alias("zz")).first()
    assert got.xy == {"a": "1", "b": "3", "c": None} and got.zx == got.xz == {"a": "1", "b": "2"} and got.zz == {}


def test_one_row_or_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert [r.v for r in N.only(df, F.col("k") == 1).collect()] == ["a"] and N.only(df, F.col("k") == 3).collect() == []
    with pytest.raises(Exception, match="more than one row"):
        N.only(df, F.col("k") == 2).collect()


def test_tenants_by_creation_and_what_they_hold(spark):
    t = spark.createDataFrame([("b", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("c", None), ("d", datetime(2023, 1, 1))], "slug string, created_at timestamp")
    assert [r.slug for r in N.by_creation(t).collect()] == ["d", "a", "b", "c"]
    assert {r.total for r in N.with_total(t).collect()} == {4}
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "tenant_slug string")
    got = {r.slug: (r.n_files, r.n_chunks, r.n_runs) for r in A.holdings(t, rows("a", "a", "b", "z"), rows("a"), rows(None, "d")).collect()}
    assert got == {"a": (2, 1, 0), "b": (1, 0, 0), "c": (0, 0, 0), "d": (0, 0, 1)}


def test_settings_are_written_back(spark, tmp_path):
    path = tmp_path / ".env"
    path.write_text("# keys\n\nA=1\n B = x=y\nnone\nA=old\n#C=no\n")
    S.write_env_file(spark, str(path), {"A": "2", "C": "é"})
    assert path.read_text() == "# keys\n\nA=2\n B = x=y\nnone\n#C=no\nC=é\n"
    S.write_env_file(spark, str(path), {"B": ""})
    assert {tuple(r) for r in S.env_file(spark, str(path)).collect()} == {("A", "2"), ("B", ""), ("C", "é")}
    S.write_env_file(spark, str(tmp_path / "new.env"), {"K": "v"})
    assert (tmp_path / "new.env").read_text() == "K=v\n"
    for bad in ({"": "x"}, {"a=b": "x"}, {"a": "x\ny"}, {"#a": "x"}):
        with pytest.raises(ValueError):
            S.write_env_file(spark, str(path), bad)
