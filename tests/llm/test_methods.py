"""What the methods add, against plain loops, and the cases that every operator must bear."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced_topk, hashed_text, packing, piece_viterbi, quality_model, quality_rules, secrets, toxicity, warc
from tests.llm.test_operators import BPE, PIECES


def entropy(w):
    return -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())


def test_window_entropy(spark):
    rng = np.random.default_rng(2)
    chars = [chr(c) for c in range(48, 58)] + [chr(c) for c in range(97, 123)]
    values = ["".join(chars[i] for i in rng.integers(0, rng.integers(1, 36), rng.integers(15, 90))) for _ in range(60)] + ["a" * 20, "ab" * 300, ""]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("e", secrets.window_entropy(F.col("v")))
    for r in df.collect():
        want = max((entropy(r.v[i : i + 20]) for i in range(len(r.v) - 19)), default=None)
        assert (r.e is None) == (want is None) and (want is None or math.isclose(r.e, want, abs_tol=1e-9))


def test_character_classes(spark):
    rows = {"letters": "QzRtLmXvTcKpWsJdHnBgYfUa", "hex": "9f8e7d6c5b4a39281706f5e4", "digits": "83920174658293017465", "mixed": "q9Zr7LmT2vXc8KpW4sJd",
            "word": "Donaudampfschifffahrtsgesellschaft", "lower": "averyveryverylongwordinlowercase", "pi": "11112222333344445555", "lines": "-" * 60}
    df = spark.createDataFrame(list(rows.items()), "doc_id string, text string")
    found = {r.doc_id: r.n_entropy for r in secrets.find_secrets(df).collect()}
    assert found == {"letters": 1, "hex": 1, "digits": 1, "mixed": 1, "word": 0, "lower": 0, "pi": 0, "lines": 0}


def test_posterior_and_kept(spark):
    """EM and Bayes' rule against plain loops over the rows' own votes."""
    good, junk = "The cat sat on the mat. It was warm and quite still.\nNobody came by. ", "ab | cd$$ | ef## | gh%% | "
    rows = [(i, good * (1 + i % 4) + f"Number {i} ends here.") for i in range(60)] + [(100 + i, junk * 5 + f"x{i} " * 3) for i in range(12)]
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    votes = {r.doc_id: tuple(r[f"vote_{n}"] for n in quality_rules.RULES) for r in got}
    model = quality_rules.estimate(sorted(Counter(votes.values()).items()))
    for r in got:
        odds = model.prior + sum(w[v + 1] for w, v in zip(model.weights, votes[r.doc_id], strict=True))
        p = 1 / (1 + math.exp(-odds))
        assert math.isclose(r.posterior, p, abs_tol=1e-9) and r.kept == (not r.base_failed and p >= 0.5)
    assert all(r.posterior > 0.5 for r in got if r.doc_id < 100) and all(r.posterior < 0.5 for r in got if r.doc_id >= 100)


def test_noisy_or_and_its_gradient(spark):
    texts = ["vile words here. a calm one.", "calm and kind. so calm!", "vile. vile. vile.", "kind"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = np.zeros(hashed_text.DIMS, np.float32)
    buf = np.frombuffer(b"vile", np.uint8)
    weights[toxicity.sentences(buf, np.array([0, 4]))[4]] = 2.5
    model = toxicity.Bags(weights, -1.5)
    for r in toxicity.score(df, model).collect():
        quiet = 1.0
        for sentence in [s for s in texts[r.doc_id].replace("!", ".").split(".") if s.strip()]:
            quiet *= 1 - 1 / (1 + math.exp(1.5 - 2.5 * sentence.split().count("vile")))
        assert math.isclose(r.score, 1 - quiet, abs_tol=1e-6)
    rows = [(i % 2, np.array([i % 2 * 7 + k for k in range(3)], "<u4") | np.array([1 << 31, 0, 0], "<u4")) for i in range(20)]
    fitted = toxicity.fit_bags(rows)
    assert fitted.weights[7] > 0 > fitted.weights[0] and not fitted.weights[20:].any()


def test_ordinal_likelihood():
    """The fitted thresholds are ordered, and small moves of a weight or threshold do not raise the penalised likelihood much."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 3
        f = np.unique(rng.integers(0, 30, 6) + 10 * y)
        rows.append((y, np.append(np.column_stack([f, np.ones(len(f), int)]).ravel(), 8)))
    model = quality_model.fit_ordinal(rows, 3, rounds=600)

    def loss(w, theta):
        total = 0.5e-4 * float((w * w).sum())
        for y, x in rows:
            z = sum(w[f] * c for f, c in zip(x[:-1:2], x[1:-1:2], strict=True)) * quality_model.SCALE / (hashed_text.PER_WORD * x[-1])
            tail = [1.0, *(1 / (1 + math.exp(t - z)) for t in theta), 0.0]
            total -= math.log(tail[y] - tail[y + 1]) / len(rows)
        return total

    w, theta = model.weights.astype(float), model.thresholds
    best = loss(w, theta)
    assert theta[0] < theta[1] and best < 0.6 * math.log(3)
    for k in (0, 15, 45):
        for step in (-0.3, 0.3):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, theta) > best - 1e-3
    for step in (-0.2, 0.2):
        assert loss(w, theta + step) > best - 1e-3


LONG = "abc def. " * 330_000  # 3 MB
SHAPE = "doc_id long, text string, words string, lines int, id int, rank int, score double, kept int, spans int, query_id int"
#: Null and repeated ids, null, empty and blank texts, equal rows, a very long text, bad UTF-8.
ROWS = [(1, "one two", "w", 1), (1, "one two", "w", 1), (None, None, None, None), (2, "", "", 0), (3, " \n\t", "x", 2), (4, LONG, "y", 3), (None, "last one", None, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, *[7] * 2, 0.5, *[7] * 3) for r in ROWS], SHAPE)
    bad = df.limit(1).withColumns({"doc_id": F.lit(9).cast("long"), "text": F.unhex(F.lit("61FF6220C3")).cast("string")})
    return df.union(bad).repartition(2).cache()


def operators(spark):
    flat = quality_model.Ordinal(np.zeros(hashed_text.DIMS, np.float32), np.array([0.0, 1.0]))
    calm = toxicity.Bags(np.zeros(hashed_text.DIMS, np.float32), -6.0)
    return {
        "rules": lambda d: quality_rules.quality_verdicts(d), "secrets": lambda d: secrets.find_secrets(d), "redact": lambda d: secrets.redact_secrets(d),
        "pieces": lambda d: piece_viterbi.round_trip(d, PIECES), "packing": lambda d: packing.packed_documents(d, BPE).where("piece = 0"),
        "toxicity": lambda d: toxicity.score(d, calm), "grades": lambda d: quality_model.score(d, flat), "select": lambda d: quality_model.select(d, flat),
        "warc": lambda d: warc.read_warc(spark, warc.write_warc(d, None, "doc_id", "words", "text"), False).withColumnRenamed("page_id", "doc_id"),
    }


@pytest.mark.parametrize("name", ["rules", "secrets", "redact", "pieces", "packing", "toxicity", "grades", "select", "warc"])
def test_odd_rows(spark, odd, name):
    run = operators(spark)[name]
    ids = Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert Counter(r.doc_id for r in run(odd).collect()) == ids  # each row is there once, also repeated and nameless ones
    assert run(odd.where("false")).count() == 0


def test_clashing_id_names(spark, odd):
    for name in ("words", "lines", "text2"):
        d = odd.select(F.col("doc_id").alias(name), "text")
        assert Counter(r[name] for r in quality_rules.quality_verdicts(d, name).collect()) == Counter(r.doc_id for r in odd.collect())
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "rank long, embedding array<double>")
    top = bitsliced_topk.top_k(v, F.col("rank") == 0, 2, id_col="rank")
    assert top.columns == ["query_id", "rank", "candidate", "score"] and sorted(r.candidate for r in top.collect()) == [1, 2]


def test_training_ignores_row_order(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d e"), (2, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    one, two = (quality_model.train(d, labels) for d in (docs.coalesce(1), docs.orderBy(F.desc("text")).coalesce(1)))
    assert (one.weights == two.weights).all() and quality_model.train(docs.where("false"), labels).weights.any() == False  # noqa: E712
