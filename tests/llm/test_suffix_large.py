"""Suffix dedup where prefixes are spread, texts are long, and columns clash."""

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S
from tests.llm.test_operators import repeats


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df).collect()}
    assert got == repeats(rows)


@pytest.mark.parametrize("spread", [2, 5, 32])
def test_common_prefixes(spark, monkeypatch, spread):
    """A phrase in every text, followed and led by few or many different ones, over tasks that spread it and tasks that do not."""
    monkeypatch.setattr(S, "SPREAD", spread)
    monkeypatch.setattr(S, "AT_ONCE", 300)
    rng = np.random.default_rng(spread)
    some = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    phrase, heads, tails = some(60), [some(70) for _ in range(4)], [some(90) for _ in range(5)]
    rows = []
    for i in range(140):
        kind = rng.integers(0, 4)
        head = heads[rng.integers(0, 4)] if kind & 1 else some(rng.integers(0, 90))
        tail = tails[rng.integers(0, 5)] if kind & 2 else some(rng.integers(0, 90))
        rows.append((i, some(rng.integers(0, 30)) + head + phrase + tail + (phrase if i % 7 == 0 else "")))
    check(spark, rows)


def test_long_texts(spark):
    """Texts over two pieces, with repeats across their edges, beside small ones."""
    rng = np.random.default_rng(1)
    word = [f"{x:x}é " for x in rng.integers(0, 1 << 40, 4000)]
    long = "".join(word[i] for i in rng.integers(0, 4000, 220_000))
    assert len(long.encode()) > 2 * S.PIECE
    at = long.encode()[S.PIECE - 300 : S.PIECE + 400].decode("utf-8", "ignore")
    check(spark, [(1, long), (2, "x" + at), (3, at[50:] + long[:5000]), (4, None), (5, "ab" * 700)], 2)


def test_clashing_names(spark):
    text = "every word of this sentence is long enough to be found again in the other row, which holds it once more, so it goes"
    rows = [(1, text, "a", 2), (2, text, "b", 3), (3, "short", None, None)]
    for name in ("id", "same", "marks", "__x"):
        df = spark.createDataFrame(rows, f"`{name}` long, text string, lost string, n_removed int")
        got = {r[name]: r.n_removed for r in S.suffix_dedup(df, name).collect()}
        assert got == {1: 0, 2: len(text), 3: 0}
        assert [r[name] for r in S.without_repeats(df, name).orderBy(name).collect()] == [1, 3]


def test_replacement_characters_of_the_source_stay(spark):
    text = "� kept, " + "".join(f"{i}é" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "� own " + text[3:] + "x")], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in S.without_repeats(df).collect()}
    assert cut[1] == text and cut[2].startswith("� own ") and len(cut[2]) < 20
