"""Search and answers, sync runs, sources, schema and streaming, with the cases that go wrong."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vector as V
from tessera.operators import chunk as C
from tessera.operators import embed as E
from tessera.operators import retrieve as R
from tessera.operators import stats as A
from tessera.operators import sync as Y
from tessera.operators import tenants as N
from tessera.sources import files as S
from tessera.sources import schema as M
from tessera.streaming import ingest as I

BLANK = "  \x1c"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_unicode_blanks(spark):
    t = F.lit(f"{BLANK}a　b\x85 c {BLANK}")
    assert one(spark, X.strip(t)) == "a　b\x85 c" and one(spark, X.words(t)) == ["a", "b", "c"] and one(spark, X.token_count(t)) == 3
    assert one(spark, X.words(F.lit(None).cast("string"))) == [] and one(spark, X.token_count(F.lit(BLANK))) == 0
    assert one(spark, X.listed(F.lit(" a, b ,,c"))) == ["a", "b", "", "c"] and one(spark, X.shortened(F.lit("x" * 101))) == "x" * 97 + "..."
    assert one(spark, X.status_mark(F.lit("unheard"))) == "❓"


def test_vectors(spark):
    zero, a = V.literal([0.0, 0.0]), V.literal([3.0, 4.0])
    assert one(spark, V.cosine_distance(zero, a)) is None and one(spark, V.cosine_distance(a, F.lit(None).cast("array<double>"))) is None
    assert one(spark, V.text_form(a)) == "[3.0,4.0]" and one(spark, V.euclidean(zero, a)) == 5.0


def test_fixed_offsets(spark):
    text = " ".join(f"w{i}é" for i in range(2000))
    rows = C.chunk(spark.createDataFrame([(1, f"\n{text}  ")], "doc_id long, text string"), "fixed").orderBy("chunk_index").collect()
    assert len(rows) == 5 and rows[0].start_char == 0 and rows[-1].content.endswith("w1999é")
    assert all(r.start_char == len(" ".join(text.split()[: 462 * r.chunk_index])) for r in rows)
    assert all(text[r.start_char + 1 : r.end_char + 1] == r.content for r in rows[1:])  # offsets begin at the blank before a window


def test_configs_refuse():
    for bad in (dict(model="x"), dict(strategy="x"), dict(size=0), dict(overlap=512), dict(max_chunks=0)):
        with pytest.raises(ValueError):
            C.ChunkConfig(**bad)
    for bad in (dict(k=0), dict(k=21), dict(threshold=1.5), dict(metric="x"), dict(model="x")):
        with pytest.raises(ValueError):
            R.SearchConfig(**bad)
    for bad in ("", " \n", "x" * 2001):
        with pytest.raises(ValueError):
            R.check_query(bad)


def test_embedder(spark):
    df = spark.createDataFrame([(1, "A b a"), (2, None), (3, f"b{BLANK}A a")], "id long, content string")
    got = {r.id: np.array(r.embedding) for r in E.embed(df).collect()}
    assert len(got[1]) == 384 and math.isclose(np.linalg.norm(got[1]), 1, rel_tol=1e-6) and not got[2].any() and (got[1] == got[3]).all()
    assert np.allclose(E.encode_query("a a B"), got[1])
    E.register("e5-large-v2", lambda: lambda texts: np.ones((len(texts), 1024)))
    try:
        assert len(E.embed(df, "e5-large-v2").first().embedding) == 1024
        E.register("e5-large-v2", lambda: lambda texts: np.ones((len(texts), 3)))
        E._built.clear()
        with pytest.raises(Exception, match="shape|cached"):
            E.embed(df.withColumn("content", F.lit("other")), "all-mpnet-base-v2").select(F.raise_error(F.lit("cached"))).collect()
    finally:
        E._factories.clear()
    with pytest.raises(ValueError):
        E.register("unheard", lambda: None)


def library(spark):
    texts = [("a", 1, "cats like warm milk and sleep"), ("a", 2, "dogs like long walks"), ("a", 3, "milk is white"), ("b", 4, "cats like warm milk")]
    docs = spark.createDataFrame([(t, i, x) for t, i, x in texts], "tenant_slug string, file_id long, text string")
    return E.embed(C.chunk_simple(docs)), docs.select("tenant_slug", "file_id", F.concat("file_id", F.lit(".txt")).alias("filename"))


def test_search_and_ask(spark):
    chunks, files = library(spark)
    view = N.TenantView("a")
    hits = R.search(view, chunks, files, "warm milk for cats", R.SearchConfig(k=2)).collect()
    assert [(r["rank"], r.chunk_id, r.filename) for r in hits] == [(1, "1:0", "1.txt"), (2, "3:0", "3.txt")]
    assert all(0 <= r.score <= 1 for r in hits) and hits[0].metadata == {"filename": "1.txt", "chunk_index": "0"}
    told = R.ask(view, chunks, files, "warm milk for cats", R.SearchConfig(threshold=0.3)).first()
    assert told.answer == "Based on the documents: cats like warm milk and sleep..." and told.confidence == 0.8 and told.tenant_id == "a" and len(told.sources) == told.n_sources == 1
    nothing = R.ask(view, chunks, files, "quantum gravity", R.SearchConfig(threshold=0.95)).first()
    assert nothing.answer == R.NOTHING and (nothing.n_sources, nothing.confidence, nothing.sources) == (0, 0.0, [])
    queries = spark.createDataFrame([(1, "a", E.encode_query("milk")), (2, "b", E.encode_query("milk")), (3, "none", E.encode_query("milk"))], "query_id long, tenant_slug string, query_vector array<float>")
    batch = R.search_batch(chunks, queries, files).collect()
    assert {r.file_id for r in batch if r.query_id == 1} == {1, 2, 3} and [r.file_id for r in batch if r.query_id == 2] == [4] and not [r for r in batch if r.query_id == 3]
    assert {r.query_id: r.n_sources for r in R.answers(queries, R.search_batch(chunks, queries, files)).collect()} == {1: 3, 2: 1, 3: 0}


def test_sync(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    snap = [("a", "a/new", "a new file of some words"), ("a", "a/same", "the same text as before"), ("a", "a/changed", "its text is another now"), ("a", "a/blank", "  \n "), ("a", "a/empty", ""), ("a", "a/again", "failed the last time")]
    snapshot = spark.createDataFrame([(t, p, sha(x), len(x), x) for t, p, x in snap], "tenant_slug string, file_path string, file_hash string, file_size long, text string")
    old = [("a/same", sha("the same text as before"), "synced"), ("a/changed", "x", "synced"), ("a/blank", "x", "synced"), ("a/gone", "x", "synced"), ("a/again", sha("failed the last time"), "failed")]
    registry = spark.createDataFrame([("a", p, h, 1, s, None) for p, h, s in old], "tenant_slug string, file_path string, file_hash string, file_size long, sync_status string, sync_error string")
    chunks = spark.createDataFrame([("a", p, 0, "old", 1, [0.0]) for p, _, _ in old], "tenant_slug string, file_path string, chunk_index int, content string, token_count long, embedding array<float>")
    done = Y.sync(snapshot, registry, chunks)
    assert {r.file_path: (r.sync_status, r.sync_error) for r in done.registry.collect()} == {"a/new": ("synced", None), "a/same": ("synced", None), "a/changed": ("synced", None), "a/again": ("synced", None), "a/blank": ("failed", "no text"), "a/empty": ("failed", "empty")}
    assert {r.file_path: r.content for r in done.chunks.collect()} == {"a/same": "old", "a/new": "a new file of some words", "a/changed": "its text is another now", "a/again": "failed the last time"}
    total = Y.outcome_summary(done.outcomes).first()
    assert (total.n_files, total.n_synced, total.n_failed, total.n_chunks, total.errors) == (5, 3, 2, 3, {"empty": 1, "no text": 1})
    again = Y.sync(snapshot, done.registry, done.chunks, retry=False)
    assert again.outcomes.count() == 0 and again.registry.count() == 6
    with pytest.raises(ValueError):
        Y.set_status(registry, F.lit(True), "unheard")
    files = spark.createDataFrame([(1,), (2,)], "file_id long")
    held = spark.createDataFrame([(1, "a"), (3, "a"), (3, "b")], "file_id long, tenant_slug string")
    assert Y.without_orphans(held, files).count() == 1 and {tuple(r) for r in Y.without_orphans(held, files, tenant="a").collect()} == {(1, "a"), (3, "b")}
    merged = Y.upsert(held, spark.createDataFrame([(None, "z"), (1, "y")], "file_id long, tenant_slug string"), "file_id")
    assert {tuple(r) for r in merged.collect()} == {(1, "y"), (3, "a"), (3, "b")}


def test_tenants(spark):
    t = spark.createDataFrame([("admin", "admin", "k0", True), ("a", "A", "k1", True), ("b", "B", "k2", False)], "slug string, name string, api_key string, is_active boolean")
    assert N.authenticate(t, "k1").slug == "a"
    for key in (None, "", "nobody's"):
        with pytest.raises(PermissionError):
            N.authenticate(t, key)
    N.require_admin(N.TenantView("admin"))
    with pytest.raises(PermissionError):
        N.require_admin(N.TenantView("a"))
    assert N.first_ordinary(t).first().slug == "a" and N.key_by_slug(t, "b", "", "spare") == "spare" and N.key_by_slug(t, "a") == "k1" and N.key_by_slug(t, "c") is None
    long = "k" * 3_000_000
    assert one(spark, N.key_of(F.lit(None).cast("string"), F.lit("Bearer " + long))) == long
    assert one(spark, N.key_of(F.lit("own"), F.lit("Bearer x"))) == "own" and one(spark, N.key_of(F.lit(None).cast("string"), F.lit("Basic x"))) is None


def test_files(spark, tmp_path):
    for path, raw in {"t1/a.txt": b"hello there\r\nworld\r", "t1/sub/b.md": b"bad \xff\xfe bytes in it", "t2/zero.txt": b"", "t2/short.txt": b"tiny"}.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    got = {r.file_path: r for r in S.snapshot(spark, str(tmp_path), with_text=True).collect()}
    assert set(got) == {"t1/a.txt", "t1/sub/b.md", "t2/zero.txt", "t2/short.txt"} and got["t1/sub/b.md"].tenant_slug == "t1"
    assert got["t1/a.txt"].text == "hello there\nworld" and got["t1/sub/b.md"].text == "bad  bytes in it" and got["t2/short.txt"].text == ""
    assert got["t2/zero.txt"].file_hash == hashlib.sha256(b"").hexdigest() and got["t1/a.txt"].file_hash == hashlib.sha256(b"hello there\r\nworld\r").hexdigest()
    assert S.snapshot(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "keys.json").write_text(json.dumps({"a": {"api_key": "k", "slug": "a", "description": "d"}}))
    (tmp_path / "bad.json").write_text("no json")
    assert [tuple(r) for r in S.keys_json(spark, str(tmp_path / "keys.json")).collect()] == [("a", "k", "d")]
    assert S.keys_json(spark, str(tmp_path / "bad.json")).count() == 0 and S.keys_json(spark, str(tmp_path / "none.json")).count() == 0
    S.write_keys_json(S.keys_json(spark, str(tmp_path / "keys.json")), str(tmp_path / "out"))
    assert [tuple(r) for r in S.keys_json(spark, str(tmp_path / "out")).collect()] == [("a", "k", "d")]
    (tmp_path / ".env").write_text("# c\n\nA=1\n B = x=y \nnone\n")
    env = S.env_file(spark, str(tmp_path / ".env"))
    assert {tuple(r) for r in env.collect()} == {("A", "1"), ("B", "x=y")} and S.env_file(spark, str(tmp_path / ".none")).count() == 0
    changed = S.env_with(env, spark.createDataFrame([("A", "2"), ("C", "3")], "key string, value string"))
    assert {tuple(r) for r in changed.collect()} == {("A", "2"), ("B", "x=y"), ("C", "3")}


def test_schema(spark):
    name = f"engine_{os.getpid()}"
    try:
        assert M.problems(spark, name) == [f"no database {name}"]
        M.create(spark, name)
        M.create(spark, name)
        assert M.problems(spark, name) == []
        spark.sql(f"DROP TABLE {name}.tenants")
        assert M.problems(spark, name) == ["no table tenants"]
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "slug string")
    assert [tuple(r) for r in M.repeated_keys(twice, "tenants").collect()] == [("a", 2)]


def test_chunk_stream(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    shape = "doc_id long, text string, at int"

    def feed(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(source)
        I.chunk_stream(spark.readStream.schema(shape).parquet(source), sink, mark, version="at").awaitTermination()
        return {r.doc_id: r.content for r in I.latest(spark, sink).collect()}

    assert feed([(1, "the first version of one", 1), (1, "the second version of one", 2), (2, "two stays as it is", 1), (3, "three will be blank", 1)]) == {1: "the second version of one", 2: "two stays as it is", 3: "three will be blank"}
    assert feed([(1, "a third version of one", 3), (3, "", 2)]) == {1: "a third version of one", 2: "two stays as it is"}


def test_event_windows_as_a_stream(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{i % 3}:30:00", "x") for i in range(9)], "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "e"))
    stream = I.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("windows")) == rows(I.event_counts(events)) and len(rows(spark.table("windows"))) == 3


def test_empty_statistics(spark):
    files = spark.createDataFrame([], "tenant_slug string, filename string, sync_status string")
    for f in (A.status_lists, A.busy_files, A.by_status):
        assert f(files).count() == 0


def test_a_reset_file_loses_its_error(spark):
    files = spark.createDataFrame([(1, "failed", "no text"), (2, "synced", None), (3, "failed", None)], "file_id long, sync_status string, sync_error string")
    assert {tuple(r) for r in Y.reset_failed(files).collect()} == {(1, "pending", None), (2, "synced", None), (3, "pending", None)}
    assert {tuple(r) for r in Y.set_status(files, F.col("file_id") == 2, "failed", "gone").collect()} == {(1, "failed", "no text"), (2, "failed", "gone"), (3, "failed", None)}
