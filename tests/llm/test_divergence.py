"""The divergence audit against plain loops, with nulls, empty groups, ties and a language without kept terms."""

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm.divergence import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, most):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({s for x, s, _ in docs if x == lang}, key=str.encode)
        counts = {s: Counter(t for x, y, terms in docs if (x, y) == (lang, s) for t in terms if t in set(kept)) for s in sources}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values())
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        shares, q = {s: share(counts[s]) for s in sources}, share(whole)
        for s in sources:
            pair = sorted(((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pair)]
            term = sorted((q[t] - shares[s][t], t.encode(), t) for t in kept if counts[s][t] and shares[s][t] > q[t])[:most]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(term)]
    return sorted(out)


def rows():
    out = []
    for i in range(160):
        words = [f"w{'abcdefghij'[(i * j) % 10]}" for j in range(i % 9)] + ["Éa", "été", "𝒳y", "Ab-cD_e"] * (i % 3)
        out.append((" ".join(words) + ("\n123 w9w" if i % 2 else ""), ["en", "fr", None, "EN"][i % 4], [f"s{i % 5}", "é", "z", None][i % 7 % 4]))
    out += [(None, "en", "silent"), ("", "xx", "a"), ("one two", "xx", "b"), ("!!! 123", "xx", "c"), ("alone", "yy", "only"), (None, None, None)]
    return out + [("hot " * 50, "en", "s1")] * 40


def test_against_loops(spark):
    df = spark.createDataFrame(rows(), "text string, lang string, source string").repartition(5).withColumns({"term": F.lit(1), "n": F.lit("n"), "total": F.lit(2.0), "doc_id": F.lit(None).cast("long")})
    for least, most in ((3, 50), (30, 4), (1, 1), (1000, 5)):
        got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence(df, least=least, most=most).collect())
        assert got == plain(rows(), least, most) and got
    assert divergence(df.where("false")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    from tessera.llm.divergence import _share

    n, total, terms = 4 * 10**14 + 7, 9 * 10**14 + 1, 10**7
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(_share("n", "total", "terms").alias("p")).first().p == 1 + int(Fraction(10**9 * (n + 5), total + 5 * terms))


def test_one_long_text(spark):
    df = spark.createDataFrame([("ab cd " * 500_000, "en", "a"), ("ab", "en", "b")], "text string, lang string, source string")
    got = {(r.source, r.part, r.item): r.value for r in divergence(df, least=1).collect()}
    assert set(got) == {("a", "pair", "b"), ("b", "pair", "a"), ("a", "term", "cd"), ("b", "term", "ab")}
