"""Syncs on disk end to end: what is rewritten, embedded, refused and logged."""

import hashlib
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import embed as E
from tessera.operators import retrieve as R
from tessera.operators import tenants as N
from tessera.operators.chunk import ChunkConfig
from tessera.operators.lease import Conflict, Lease, Lost
from tessera.operators.runlog import RunLog
from tessera.operators.store import Store
from tessera.operators.vectorstore import VectorStore
from tessera.sources.buckets import Buckets

SHAPE = "tenant_slug string, file_path string, file_hash string, file_size long, text string"


class Clock:
    def __init__(self):
        self.now = datetime(2024, 5, 1, tzinfo=UTC)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


def snap(spark, texts, tenant="a"):
    rows = [(tenant, p, hashlib.sha256(t.encode()).hexdigest(), len(t), t) for p, t in texts.items()]
    return spark.createDataFrame(rows, SHAPE)


def stamps(root, table):
    """Data files of a table with their times and sizes."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{root}/{table}") for n in names if n.endswith(".parquet")}


def test_two_syncs(spark, tmp_path):
    root, clock, numbers = str(tmp_path), Clock(), iter(range(100))
    store = Store(spark, root, buckets=8, clock=clock, ids=lambda: f"run{next(numbers)}")
    texts = {f"f{i}.txt": f"text number {i} with some words" for i in range(30)} | {"copy.txt": "text number 3 with some words", "blank.txt": "   ", "empty.txt": ""}
    first = store.sync("a", snap(spark, texts))
    assert first.status == "completed" and first.counts == {"files_processed": 33, "files_added": 33, "files_updated": 0, "files_deleted": 0, "chunks_created": 31}
    assert first.embedded == 30  # the copy is embedded once
    assert {r.file_path: r.sync_error for r in store.registry().where("sync_status = 'failed'").collect()} == {"blank.txt": "no text", "empty.txt": "empty"}

    # nothing changed but the two that failed: only their buckets are rewritten, nothing is embedded
    before = stamps(root, "files"), stamps(root, "chunks")
    calm = store.sync("a", snap(spark, texts), retry=False)
    assert calm.counts["files_processed"] == 0 and calm.embedded == 0 and calm.rewritten == 0 and (stamps(root, "files"), stamps(root, "chunks")) == before

    changed = dict(texts) | {"f1.txt": "text number one is another now", "f40.txt": "a new file has come"}
    del changed["f2.txt"]
    second = store.sync("a", snap(spark, changed), retry=False)
    assert second.counts == {"files_processed": 2, "files_added": 1, "files_updated": 1, "files_deleted": 1, "chunks_created": 2} and second.embedded == 2
    touched = {r.bucket for r in spark.createDataFrame([("f1.txt",), ("f40.txt",), ("f2.txt",)], "file_path string").select(store._files.bucket().alias("bucket")).collect()}
    for table, old in zip(("files", "chunks"), before, strict=True):
        new = stamps(root, table)
        moved = {int(p.split("bucket=")[1].split("/")[0]) for p in set(old.items()) ^ set(new.items()) for p in [p[0]]}
        assert moved == touched and len(touched) < 8
    assert {r.file_path: r.content for r in store.chunks().collect()} == {p: t for p, t in changed.items() if len(t.strip()) >= 10}
    assert store.registry().count() == len(changed)

    # history and metrics come from the log that the syncs wrote
    assert [(r.run_id, r.status, r.files_deleted, r.error_details) for r in store.log.history("a", 5).collect()] == [("run2", "completed", 1, {}), ("run1", "completed", 0, {}), ("run0", "completed", 0, {"empty": "1", "no text": "1"})]
    m = store.log.metrics().first()
    assert (m.n_runs, m.success_rate) == (3, 100.0) and m.avg_duration > 0

    # another tenant's rows are left alone, and its equal texts are not embedded again
    other = store.sync("b", snap(spark, {"x.txt": "text number 5 with some words"}, "b"))
    assert other.embedded == 0 and store.registry().where("tenant_slug = 'a'").count() == len(changed) and store.chunks().where("tenant_slug = 'b'").count() == 1
    hits = R.search(N.TenantView("b"), store.chunks(), store.files(), "number 5").collect()
    assert [(h.filename, h.file_id) for h in hits] == [("x.txt", "x.txt")]


def test_one_sync_at_a_time(spark, tmp_path):
    clock = Clock()
    store = Store(spark, str(tmp_path), buckets=4, clock=clock)
    with store.lease("a").held():
        assert store.sync("a", snap(spark, {"x": "words enough to chunk"})).status == "conflict"
        assert store.sync("b", snap(spark, {"x": "words enough to chunk"}, "b")).status == "completed"
    assert store.log.history("a").count() == 0
    assert store.sync("a", snap(spark, {"x": "words enough to chunk"})).status == "completed"
    with pytest.raises(Exception, match="nowhere"):
        store.sync("a", snap(spark, {"y": "z"}).withColumn("text", F.raise_error(F.lit("nowhere")).cast("string")))
    assert [r.status for r in store.log.history("a").collect()] == ["failed", "completed"] and "nowhere" in store.log.history("a", 1).first().error_message
    assert store.sync("a", snap(spark, {"x": "words enough to chunk"})).status == "completed"  # the lease was given back


def test_lease(spark, tmp_path):
    now = [1000.0]
    lease = lambda: Lease(spark, str(tmp_path), "tenant / with: signs", 60, lambda: now[0])
    one, two, three = lease(), lease(), lease()
    one.take()
    with pytest.raises(Conflict):
        two.take()
    now[0] += 50
    one.beat()
    now[0] += 50
    with pytest.raises(Conflict):
        two.take()
    now[0] += 20  # 70 s since the last beat
    assert one.holder_until() is None
    two.take()
    for call in (one.check, one.beat):
        with pytest.raises(Lost):
            call()
    with pytest.raises(Conflict):
        three.take()
    two.give_back()
    three.take()
    three.check()
    assert three.number == 3


def test_of_many_takers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def take(_):
        try:
            Lease(spark, str(tmp_path), "a").take()
            return 1
        except Conflict:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(take, range(16))) == 1


def test_a_broken_sync_is_run_again(spark, tmp_path, monkeypatch):
    """The chunks are written and the registry is not: the next sync does the same work and ends with the same tables."""
    store = Store(spark, str(tmp_path), buckets=4, clock=Clock())
    texts = {f"f{i}": f"some words of file {i}" for i in range(6)}
    store.sync("a", snap(spark, texts))
    texts["f1"] = "quite other words than before"
    monkeypatch.setattr(store._files, "replace", lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        store.sync("a", snap(spark, texts))
    monkeypatch.undo()
    again = store.sync("a", snap(spark, texts))
    assert again.counts["files_updated"] == 1 and again.embedded == 0
    assert {r.file_path: r.content for r in store.chunks().collect()} == texts and store.chunks().count() == 6


def test_two_models_of_one_length_do_not_mix(spark, tmp_path, monkeypatch):
    from tessera.operators import chunk as C

    monkeypatch.setitem(C.MODELS, "other-model", 384)
    monkeypatch.setitem(E._factories, "other-model", lambda: lambda texts: __import__("numpy").ones((len(texts), 384)))
    store = Store(spark, str(tmp_path), buckets=2, clock=Clock())
    store.sync("a", snap(spark, {"x": "cats like warm milk"}))
    store.sync("a", snap(spark, {"x": "cats like warm milk", "y": "dogs like long walks"}), ChunkConfig(model="other-model"))
    assert {r.file_path: r.embedding_model for r in store.chunks().collect()} == {"x": "all-MiniLM-L6-v2", "y": "other-model"}
    found = lambda m: [r.file_id for r in R.search(N.TenantView("a"), store.chunks(), store.files(), "milk", R.SearchConfig(model=m)).collect()]
    assert found("all-MiniLM-L6-v2") == ["x"] and found("other-model") == ["y"]


def test_upkeep(spark, tmp_path):
    """Deletion, orphans and failed files rewrite their own buckets and leave the other tenant alone."""
    store = Store(spark, str(tmp_path), buckets=4, clock=Clock())
    for tenant in ("a", "b"):
        store.sync(tenant, snap(spark, {"x": "words enough to chunk", "y": "other words enough", "blank": " "}, tenant))
    paths = spark.createDataFrame([("x",), ("nowhere",)], "file_path string")
    assert store.delete("a", paths) == 2 and store.delete("a", paths) == 0
    held = lambda df: sorted((r.tenant_slug, r.file_path) for r in df.collect())
    assert held(store.chunks()) == [("a", "y"), ("b", "x"), ("b", "y")] and ("b", "x") in held(store.registry()) and ("a", "x") not in held(store.registry())
    store._files.replace(store.registry().where("false"), spark.createDataFrame([("y",)], "file_path string"), {"tenant_slug": "a"})  # its chunk stays behind
    assert store.clean("a") == 1 and store.clean("a") == 0 and held(store.chunks()) == [("b", "x"), ("b", "y")]
    assert store.reset_failed("a") == 1 and store.reset_failed("a") == 0
    assert {(r.tenant_slug, r.file_path, r.sync_status, r.sync_error) for r in store.registry().where("file_path = 'blank'").collect()} == {("a", "blank", "pending", None), ("b", "blank", "failed", "no text")}
    with store.lease("b").held(), pytest.raises(Conflict):
        store.reset_failed("b")


def test_vector_store(spark, tmp_path):
    v = VectorStore(spark, str(tmp_path / "v"))
    t = spark.createDataFrame([("h1", "one"), ("h1", "one"), ("h2", "two"), (None, "none")], "chunk_hash string, content string")
    assert v.add(t, "all-MiniLM-L6-v2") == 2 and v.add(t, "all-MiniLM-L6-v2") == 0
    assert v.add(t.where("false"), "all-MiniLM-L6-v2") == 0
    got = v.joined(t, "all-MiniLM-L6-v2").collect()
    assert len(got) == 3 and all(len(r.embedding) == 384 for r in got)
    with pytest.raises(ValueError):
        v.add(t, "unheard")


def test_buckets(spark, tmp_path):
    b = Buckets(spark, str(tmp_path), "k long, v string", "k", buckets=4)
    assert b.read().count() == 0
    rows = lambda r: spark.createDataFrame(r, "k long, v string")
    b.replace(rows([(i, "a") for i in range(20)]), rows([(i, "") for i in range(20)]))
    b.replace(rows([(3, "b"), (3, "c"), (None, "d")]), rows([(3, ""), (4, ""), (None, "")]))
    assert sorted((r.k, r.v) for r in b.read().collect()) == sorted([(i, "a") for i in range(20) if i not in (3, 4)] + [(3, "b"), (3, "c")])
    b.replace(rows([]), rows([(i, "") for i in range(20)]))
    assert b.read().count() == 0 and b.replace(rows([]), rows([])) == 0
    with pytest.raises(ValueError, match="buckets"):
        Buckets(spark, str(tmp_path), "k long, v string", "k", buckets=8)


def test_run_log_refuses_what_it_does_not_know(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"))
    with pytest.raises(ValueError):
        log.start("r", "a", "odd_sync", datetime(2024, 1, 1))
    log.start("r", "a", "file_sync", datetime(2024, 1, 1))
    assert log.history("a").first().status == "running"
