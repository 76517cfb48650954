"""Product codes against plain loops over integers, and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes as V


def plain(rows):
    """rows: (id, label, vector) -> (id, code, error, label_error), digest; by loops."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    step = len(kept[0][2]) // 16
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:64]
    books = [[cut(v, p) for _, _, v in first] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(2):
        for p in range(16):
            held = {}
            for _, _, v in kept:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for j, vs in held.items():
                books[p][j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    coded, sums = [], {}
    for i, label, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(16)]
        error = sum(d for d, _ in found)
        coded.append((i, label, "".join(f"{j:02x}" for _, j in found), error))
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, code, error, sums[label]) for i, label, code, error in coded), key=repr), digest


def run(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").repartition(3).withColumns({"id": F.lit("x"), "code": F.lit(1), "error": F.lit("e"), "of": F.lit(0), "salt": F.lit(9)})
    out = V.vector_codes(df).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=repr), {r.codebooks_sha256 for r in out}


def vectors(n, width, seed=1, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, width))
    return [(i, None if i % 7 == 0 else int(i % 3), [float(np.float32(x)) for x in scale * (centres[i % 9] + 0.1 * r.normal(size=width))]) for i in range(n)]


@pytest.mark.parametrize(("n", "width"), [(300, 64), (150, 16), (90, 112), (20, 32), (1, 16)])
def test_codes(spark, n, width):
    rows = vectors(n, width)
    want, digest = plain(rows)
    got, found = run(spark, rows)
    assert got == want and found == {digest}


def test_copies_ties_and_repeated_ids(spark):
    rows = [(i % 40, 1, [float(i % 3)] * 32) for i in range(160)]
    want, digest = plain(rows)
    assert run(spark, rows) == (want, {digest})
    rows = [(None, 2, r[2]) if i % 5 == 0 else r for i, r in enumerate(vectors(100, 16))]
    want, digest = plain(rows)
    assert run(spark, rows) == (want, {digest})


def test_large_components(spark):
    rows = vectors(80, 16, scale=2.0**22)
    want, digest = plain(rows)
    assert run(spark, rows, "double") == (want, {digest})


def test_vectors_that_take_no_part(spark):
    rows = vectors(70, 16)
    odd = [(100, 1, None), (101, 1, [None] + [1.0] * 15), (102, 1, [float("nan")] * 16), (103, 1, [float("-inf")] + [0.0] * 15)]
    short = [(104, 1, [1.0] * 5), (105, 1, [])]
    want, digest = plain(rows)
    got, found = run(spark, rows + odd + short)
    assert got == sorted([*want, (104, None, None, None), (105, None, None, None)], key=repr) and found == {digest}
    assert run(spark, odd) == ([], set())
    assert run(spark, []) == ([], set())
    with pytest.raises(ValueError, match="equal parts"):
        run(spark, [(1, 1, [1.0] * 17)])


def test_bounds_keep_every_nearest_entry():
    r = np.random.default_rng(5)
    for width in (1, 2, 3, 4, 7, 8, 13, 32):
        for scale in (1, 300, 1 << 20, 1 << 34, 1 << 58):
            x = (r.normal(size=(200, width)) * scale).astype(np.int64)
            c = np.concatenate([(r.normal(size=(40, width)) * scale).astype(np.int64), x[:10], x[:10]])
            at, d = V.nearest(x, c)
            full = ((x.astype(object)[:, None, :] - c.astype(object)[None]) ** 2).sum(axis=2)
            assert d.tolist() == full.min(axis=1).tolist() and at.tolist() == [row.index(min(row)) for row in full.tolist()]


def test_bounds_leave_few_entries(monkeypatch):
    """On grouped vectors the first level already drops most entries."""
    r = np.random.default_rng(6)
    c = (r.normal(size=(64, 16)) * 1000).astype(np.int64)
    x = c[r.integers(0, 64, 500)] + r.integers(-20, 20, (500, 16))
    seen = []
    real = np.nonzero
    monkeypatch.setattr(V.np, "nonzero", lambda a: seen.append(int(np.count_nonzero(a))) or real(a))
    V.nearest(x, c)
    assert seen[0] < 500 * 16


def test_decode_gives_what_the_error_says(spark):
    rows = vectors(120, 32)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    fit = V.usable(df)
    books = V.train(fit, 32)
    by = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    for r in V.decode(V.encode(fit, 32, books), books).collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(by[r.id], r.vector, strict=True))
