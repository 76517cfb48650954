"""Ids that repeat or are missing, with texts that differ; and what the methods' tests left out."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_jaccard, packing, quality_model, quality_rules, suffix_dedup
from tests.conftest import SF
from tests.llm.test_operators import repeats


def text(seed, words):
    r = np.random.default_rng(seed)
    return " ".join(f"v{x}" for x in r.integers(0, 1 << 40, words))


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c = text(1, 40), text(2, 40), text(3, 40)
    rows = [(1, a), (2, a + " | " + b), (2, c), (2, c), (None, b), (None, a + c), (3, c[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"key": F.lit(1), "same": F.lit("x")})
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect())
    # the same with ids of their own: one document for equal rows, in the order of id and then of the text's hash, null last
    distinct = spark.createDataFrame(sorted(set(rows), key=repr), "doc_id long, text string").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(distinct, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    want = repeats([(i, r.text) for i, r in enumerate(order)])
    expect = Counter()
    for i, r in enumerate(order):
        expect[(r.doc_id, *want[i])] += rows.count((r.doc_id, r.text))
    assert got == expect
    # nothing that stands once is lost
    kept = [r.text for r in suffix_dedup.without_repeats(df).collect()]
    for whole in (a, b, c):
        assert any(whole in k for k in kept)


def test_jaccard_keeps_the_links_of_all_rows_of_an_id(spark):
    a, b, c = text(4, 60), text(5, 60), text(6, 60)
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b.upper().replace("V", "v")), (8, c), (None, a), (None, None), (9, None), (9, ""), (3, "lone words here")]
    for seed in range(3):
        df = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(seed)).repartition(3)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_groups(df).collect())
        assert got == Counter({(1, 57, 1): 1, (5, 57, 1): 3, (7, 57, 1): 1, (8, 57, 8): 1, (None, 57, None): 1, (None, 0, None): 1, (9, 0, 9): 2, (3, 1, 3): 1})
    kept = ngram_jaccard.one_per_group(df)
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 8: 1, None: 2, 9: 2, 3: 1})


def test_packing_goes_on_while_it_gains(spark, monkeypatch):
    """More rounds than six, each of two partitions of a few pieces: the bins' floor is not reached, but a third of what single partitions would leave is saved."""
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rounds = []
    real = packing.stash
    monkeypatch.setattr(packing, "stash", lambda df, name="t", *a: rounds.append(name) or real(df, name, *a))
    r = np.random.default_rng(7)
    sizes = [int(x) for x in r.integers(3, 60, 1500)]
    alone = sum(len(packing.best_fit(sizes[i : i + 5], 128)) for i in range(0, 1500, 5))
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "id long, piece int, start long, length long, crc long").repartition(300)
    out = packing.pack(df, 128).collect()
    assert len(rounds) > 7 and Counter(x.id for x in out) == Counter(range(1500))
    fills = Counter()
    for x in out:
        fills[x.sequence] += x.length
    assert max(fills.values()) <= 128 and len(fills) <= 1.15 * sum(sizes) / 128 and len(fills) < 0.8 * alone


def test_expectation_maximisation_by_itself(spark):
    """The model against arrays: rows one by one in place of counted patterns, all rules at once in place of loops."""
    r = np.random.default_rng(3)
    m, n = len(quality_rules.RULES), 400
    good = r.random(n) < 0.7
    accuracy = np.linspace(0.6, 0.95, m)
    votes = np.where(r.random((n, m)) < 0.3, 0, np.where((r.random((n, m)) < accuracy) == good[:, None], 1, -1))
    model = quality_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()))
    cast = (votes != 0).sum(axis=1)
    p = np.where(cast > 0, np.clip((votes > 0).sum(axis=1) / np.maximum(cast, 1), 0.05, 0.95), 0.5)
    for _ in range(60):
        side = np.stack([1 - p, p])
        rate = np.stack([(1 + np.einsum("sn,nm->sm", side, votes == v)) for v in (-1, 0, 1)], axis=2)
        rate /= rate.sum(axis=2, keepdims=True)
        weight = np.log(rate[1] / rate[0])
        prior = math.log((1 + side[1].sum()) / (1 + side[0].sum()))
        p = 1 / (1 + np.exp(-(prior + np.take_along_axis(weight, votes.T + 1, axis=1).sum(axis=0))))
    assert np.allclose(np.array(model.weights), weight, atol=1e-9) and math.isclose(model.prior, prior, abs_tol=1e-9)
    assert ((p >= 0.5) == good).mean() > 0.9


def test_grades_of_rows_that_were_not_trained_on(spark):
    d = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality_model.train(docs, labels.where(seen))
    rows = quality_model.select(docs, model).select("doc_id").withColumn("kept", F.lit(True))
    judged = labels.where(~seen).where("quality is not null").join(docs.select("doc_id"), "doc_id").join(rows, "doc_id", "left").collect()
    low, fine = ([bool(r.kept) for r in judged if r.quality == q] for q in (0, 1))
    assert len(low) > 5 and np.mean(low) < 0.1 and np.mean(fine) > 0.98


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_no_negative_zero(spark):
    from tessera.llm import hashed_text, toxicity

    calm = toxicity.Bags(np.zeros(hashed_text.DIMS, np.float32), -6.0)
    df = spark.createDataFrame([(1, ""), (2, None), (3, "...")], "doc_id long, text string")
    assert [math.copysign(1, r.score) for r in toxicity.score(df, calm).collect()] == [1, 1, 1]


@pytest.mark.parametrize("bad", [b"\xff\xfe", b"ab\xc3"])
def test_bytes_that_are_no_text(spark, bad):
    a = text(9, 40).encode() + bad
    df = spark.createDataFrame([(1, a), (2, a + b" tail"), (None, a), (2, None)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {(1, len(a)): 0, (2, len(a) + 5): len(a), (None, len(a)): len(a), (2, 0): 0}
    assert hashlib.sha256(b"").hexdigest() in {r.kept_sha256 for r in suffix_dedup.suffix_dedup(df).collect()}
    assert {r.component_id for r in ngram_jaccard.ngram_jaccard_groups(df.where("text is not null and doc_id is not null")).collect()} == {1}
