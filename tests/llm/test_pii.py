"""Personal data against the base patterns run plainly, planted cases of the further kinds, and odd rows."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    out = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(out)


def found_base(text):
    return [(s.start, s.kind, s.end) for s in pii.spans(text) if s.kind < len(pii.BASE)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@+-_ 0129()é\n", max_size=60) | st.lists(st.sampled_from(["4539 1488 0343 6467", "1.2.3.4", "300.1.1.1", "a.b@c.d", "@", "+1 (017) 555-7713", "+", ".5", "0", "@x.y_z@q.r", "-", " ", "é"]), max_size=12).map("".join))
def test_base_spans(text):
    assert found_base(text) == base(text)


CASES = [
    ("pay to DE89 3704 0044 0532 0130 00 AND MORE", "iban", "DE89 3704 0044 0532 0130 00"),
    ("GB82WEST12345698765432", "iban", "GB82WEST12345698765432"),
    ("my SSN is 078-05-1120.", "ssn", "078-05-1120"),
    ("call me: (212) 555-0199", "local", "(212) 555-0199"),
    ("credit card 4539.1488.0343.6467", "spaced", "4539.1488.0343.6467"),
]


def test_further_kinds():
    for text, kind, value in CASES:
        assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in pii.spans(text) if s.kind >= len(pii.BASE)] == [(kind, value)], text
    for text in ("DE89 3704 0044 0532 0130 01", "XX89370400440532013000", "ssn 000-12-3456", "ssn 078-00-1120", "a 078-05-1120", "order 212 555-0199", "credit card 4539.1488.0343.6468", "4539.1488.0343.6467"):
        assert not [s for s in pii.spans(text) if s.kind >= len(pii.BASE)], text


def test_scores_follow_the_words_nearby():
    score = lambda t: pii.spans(t)[0].score
    assert score("server 10.1.2.3") > score("was 10.1.2.3") > score("version 10.1.2.3")
    assert score("visa 4539148803436467") > score("the 4539148803436467") > score("order 4539148803436467")
    assert score("x" * 30 + " card " + "y" * 80 + " 4539148803436467") == pii.SCORE["card"]


def test_checksums():
    random.seed(3)
    for _ in range(200):
        d = "".join(random.choice("0123456789") for _ in range(random.randint(12, 19)))
        assert pii.luhn(d) == luhn(d)
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


def written(rows, text):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in rows)


def test_rows(spark):
    texts = [
        (1, "mail a.b@c.org, 10.0.0.1 or +1 (017) 555-7713 é 4539 1488 0343 6467"), (2, None), (3, ""), (4, "a" * 2_000_000 + "@"), (5, "1" * 1_000_000),
        (6, "+1" + "(" * 1_000_000), (7, "x@" * 300_000 + "y.z"), (1, "x@y.z x@y.z"), (None, "x@y.z"), (8, "1." * 400_000), (9, "𝒳 x@y.z 😀 my ssn 078-05-1120"),
        (10, "A1" * 400_000),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"id": F.lit("x"), "found": F.lit(1), "spans": F.lit(2), "start": F.lit(3)})
    got = {}
    for r in pii.pii_digest(pii.find_pii(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    for i, text in texts:
        t = text or ""
        if len(t) > 10_000 and i not in (5,):
            continue  # the plain patterns are quadratic on these
        want = base(t) if i != 5 else []
        assert any(r.base_sha256 == hashlib.sha256(written(want, t).encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)] for r in got[i])
    assert got[9][0].spans == "email:2:7,ssn:17:28" and got[9][0].n_further == 1
    assert got[4][0].spans == "" and got[7][0].n_email == 1 and got[8][0].n_ip == 100_000 and got[10][0].spans == ""
    assert pii.pii_digest(pii.find_pii(df.where("false"))).count() == 0
    masked = {r.doc_id: r.text for r in pii.redact_pii(df.where("doc_id in (2, 3, 9)")).collect()}
    assert masked == {2: None, 3: "", 9: "𝒳 [EMAIL] 😀 my ssn [SSN]"}
    assert pii.redact_pii(df).columns == df.columns


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('ff2061406266622e64') as string) as text")
    assert pii.pii_digest(pii.find_pii(df)).first().spans == "email:2:9"
