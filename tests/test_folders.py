"""Listing in tasks against a plain walk."""

import hashlib
import os

import pytest

from tessera.sources import files as S
from tessera.sources import folders as D


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "up load"
    deep = "/".join(f"d{i}" for i in range(40))
    names = [f"t{i % 7}/wide{i % 31}/file{i}.txt" for i in range(900)] + [f"t0/{deep}/last.txt", "t1/zero", "t2/.hidden", "t3/ümlaut é.md", "top.txt", "t4/a b%20c/x#y.txt"]
    for i, name in enumerate(names):
        os.makedirs(os.path.dirname(top / name), exist_ok=True)
        (top / name).write_bytes(b"" if name == "t1/zero" else name.encode() * (i % 5 + 1))
    os.makedirs(top / "t5/empty/folder")
    return top


def walked(root):
    return {os.path.relpath(os.path.join(d, n), root): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names}


@pytest.mark.parametrize("form", [str, lambda p: p.as_uri()])
def test_every_file_of_a_deep_and_wide_tree(spark, root, form):
    got = D.tree(spark, form(root))
    assert {r.path: r.file_size for r in got.collect()} == walked(root) and got.count() == len(walked(root))
    assert {r.file_path for r in S.listing(spark, str(root)).collect()} == set(walked(root))


def test_snapshot_by_tasks_and_by_driver(spark, root):
    want = {p: (n, hashlib.sha256((root / p).read_bytes()).hexdigest(), (root / p).read_text().strip() if n >= 10 else "") for p, n in walked(root).items()}
    tasks = {r.file_path: (r.file_size, r.file_hash, r.text) for r in S.snapshot(spark, str(root), with_text=True).collect()}
    assert tasks == want
    plain = {r.file_path: r.file_hash for r in S.snapshot(spark, str(root)).collect()}
    assert plain == {p: h for p, (_, h, _) in want.items()}
    by_driver = {r.file_path: (r.file_size, r.file_hash) for r in S.snapshot(spark, str(root), by="driver").collect()}
    assert {p for p in want if "%20" not in p and "#" not in p and "/." not in p} <= set(by_driver)


def test_missing_root_and_circle(spark, tmp_path):
    assert D.tree(spark, str(tmp_path / "nowhere")).count() == 0
    (tmp_path / "a").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "a" / "loop")
    with pytest.raises(ValueError, match="circle"):
        D.tree(spark, str(tmp_path), deepest=6)
    with pytest.raises(ValueError, match="driver"):
        S.listing(spark, str(tmp_path), by="magic")


def test_file_that_cannot_be_read_keeps_its_row(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("here and then gone")
    files = S.listing(spark, str(tmp_path)).cache()
    assert files.count() == 1
    os.remove(tmp_path / "t" / "x.txt")
    assert [(r.file_path, r.file_hash) for r in D.hashed(files, str(tmp_path)).collect()] == [("t/x.txt", "")]


def test_paths_stay_out_of_the_driver(spark, root, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: pytest.fail("rows came to the driver"))
    D.tree(spark, str(root)).write.format("noop").mode("overwrite").save()
