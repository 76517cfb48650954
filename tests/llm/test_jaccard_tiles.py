"""The n-gram join with one key held by a third of the rows, over many tasks, on both sides of its size checks."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components as C
from tessera.llm import ngram_jaccard as J
from tests.llm.test_operators import groups


def near_copies(seed, size, words, edits, loose):
    """A large group of near copies, among them some that drift, beside texts that hold the group's passage and little else of it."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 400, words)]
    rows = []
    for i in range(size):
        t = list(base)
        for j in rng.integers(0, words, rng.integers(0, edits + 1)):
            t[j] = f"x{rng.integers(0, 40)}"
        rows.append((len(rows), " ".join(t)))
    for i in range(loose):
        own = [f"y{k}" for k in rng.integers(0, 300, rng.integers(3, 40))]
        rows.append((len(rows), " ".join(own + base[: words // 2])))
    rows += [(len(rows) + i, rows[i % 5][1].upper()) for i in range(size // 3)]  # copies
    return [(int(i), t) for i, t in rows]


@pytest.mark.parametrize("few", [0, 1_000_000])
@pytest.mark.parametrize("tile", [16, 1024])
def test_large_group(spark, monkeypatch, few, tile):
    monkeypatch.setattr(J, "BROADCAST_IDS", few)
    for module in (J, C):
        monkeypatch.setattr(module, "BROADCAST_NODES", few)
    monkeypatch.setattr(J, "TILE", tile)
    rows = near_copies(few + tile, 120, 60, 3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard_groups(df).collect()}
    assert got == groups(rows)


def test_one_per_group(spark):
    rows = near_copies(5, 60, 80, 4, 30) + [(900, None), (901, ""), (902, "one"), (903, "ONE")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, id long, component_id string")
    kept = J.one_per_group(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {top for _, top in groups(rows, 5, 80).values()}
    assert J.one_per_group(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_large_components_further_holders(spark, monkeypatch, few):
    """A batch sends one holder of a large component; the others come for the keys that need them."""
    monkeypatch.setattr(J, "BROADCAST_IDS", few)
    monkeypatch.setattr(J, "HOLDERS", 2)
    rows = near_copies(few + 3, 120, 60, 3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in J.ngram_jaccard_groups(df).collect()}
    assert got == {i: top for i, (_, top) in groups(rows).items()}


def test_what_tiles_send():
    """All that comes back of sent tiles: each holder of a key that several components hold, and no other; ids far apart too."""
    ids = np.array([5, 7, 9, -(1 << 62), 1 << 62, 11, 12, 13], np.int64)
    comps = np.array([5, 5, 9, -(1 << 62), -(1 << 62), 11, 11, 11], np.int64)
    held = [[1 << 12, 3 << 12], [1 << 12], [1 << 12, 2 << 12], [2 << 12, 4 << 12], [2 << 12, 4 << 12], *[[6 << 12]] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comps), pa.array(held, pa.list_(pa.int64()))], ["id", "comp", "keys"])
    sent = pa.Table.from_batches(J._send_tiles(3)([batch])).sort_by("bucket")
    got = {(r["id"], r["key"] >> 28, r["comp"]) for b in J._torn(sent.to_batches()) for r in b.to_pylist()}
    assert got == {(5, 1, 5), (7, 1, 5), (9, 1, 9), (9, 2, 9), (-(1 << 62), 2, -(1 << 62)), (1 << 62, 2, -(1 << 62))}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_torn_keys_are_not_asked_back(spark, monkeypatch, few):
    """Holders of torn keys come with the keys: at any number of torn keys the rows' keys are not exploded and shuffled again."""
    monkeypatch.setattr(J, "BROADCAST_IDS", few)
    plans, stash = [], J.stash

    def noted(df, name="t", *a, **b):
        if name == "members":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stash(df, name, *a, **b)

    monkeypatch.setattr(J, "stash", noted)
    df = spark.createDataFrame(near_copies(8, 10, 60, 3, 30), "doc_id long, text string").repartition(9)
    J.ngram_jaccard_groups(df).count()
    assert plans and not any("Generate explode" in p for p in plans)
