"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust their score.

Kinds of the base list: email, ip, card (Luhn), phone. Of these every confirmed match stays; its score only tells how
sure it is. Further kinds are reported where their score reaches LEAST: iban (mod-97 and the country's length), ssn
(number ranges), local (a telephone number without +) and spaced (a card number with other gaps, Luhn). A span of a further kind
that overlaps a base one, or an earlier kind of its own list, is not reported.

A score is the kind's own, plus NEAR where a word of the kind stands within BEFORE characters in front or AFTER behind,
less AWAY where a word stands there that such numbers are often mistaken with. Patterns run in linear time: none can start inside a run
that it has already tried.

Spans are code points, end exclusive; bytes that are no UTF-8 are read as U+FFFD. Edge cases: null counts as empty; texts
without a find have empty spans; a text may be found under several kinds; rows with a repeated or null id are scanned
each; extra columns are ignored; no rows give no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tasks import lean

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "local", "spaced")
KINDS = BASE + FURTHER
LEAST, NEAR, AWAY = 0.6, 0.3, 0.3
BEFORE, AFTER = 48, 24
#: The score of a confirmed span by itself.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local": 0.4, "spaced": 0.4}
#: Words that make a kind likelier, and those that make it less likely.
WORDS = {
    "email": r"e-?mail|mail|contact|correo|courriel|adresse",
    "ip": r"ip|host|server|client|address|login|adresse|servidor|serveur",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|karte|kreditkarte|tarjeta|carte",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|telefon|handy|tel[eé]fono|t[eé]l[eé]phone|m[oó]vil",
    "iban": r"iban|account|bank|konto|cuenta|compte",
    "ssn": r"ssn|social security|security number|sozialversicherung",
}
WORDS |= {"local": WORDS["phone"], "spaced": WORDS["card"]}
NOT = {"ip": r"version|release|section|chapter|v", "card": r"order|invoice|isbn|tracking|serial", "phone": r"order|invoice|isbn|serial", "iban": r"serial", "ssn": r"order|invoice|isbn|part", "local": r"order|invoice|isbn|part", "spaced": r"order|invoice|isbn|tracking|serial"}
_NEAR = {k: re.compile(rf"(?<!\w)(?:{w})(?!\w)") for k, w in WORDS.items()}
_AWAY = {k: re.compile(rf"(?<!\w)(?:{w})(?!\w)") for k, w in NOT.items()}

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,40}")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SPACED = re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9])+")
#: Length of an IBAN by country.
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 "
    "NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
_TENS = {c: str(ord(c) - 55) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
FOUND = "array<struct<start:bigint,kind:string,end:bigint,score:double>>"


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(_DOUBLED[d] for d in back[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: the first four characters go to the end, letters count from 10."""
    return int("".join(_TENS.get(c, c) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match ends its local part at an @, which no local part holds, so one look at each @ is enough."""
    low, at = 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at)
        start = low + len(text[low:at].rstrip(LOCAL_CHARS)) if host else at
        if start < at:
            yield start, host.end()
            low = host.end()
        else:
            low = at + 1
        at = text.find("@", low)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def cards(text: str, pattern: re.Pattern = CARD) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Cut to the country's length, since capitals may follow."""
    for m in IBAN.finditer(text):
        want, end, seen = IBAN_LENGTH.get(m[0][:2], 0), m.start(), 0
        while end < m.end() and seen < want:
            seen += text[end] != " "
            end += 1
        if want and seen == want and not text[end : end + 1].isalnum() and mod97(m[0][: end - m.start()].replace(" ", "")):
            yield m.start(), end


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - BEFORE) : start]}\n{text[end : end + AFTER]}".lower()
    score = SCORE[kind] + NEAR * bool(_NEAR[kind].search(around)) - AWAY * bool(kind in _AWAY and _AWAY[kind].search(around))
    return round(min(1.0, max(0.0, score)), 2)


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    out: list[Span] = []
    some = any(c in text for c in "0123456789")
    found = {"email": emails(text) if "@" in text else (), "phone": phones(text) if "+" in text else ()}
    found |= {"ip": ips(text), "card": cards(text)} if some else {}
    for kind in BASE:
        out += [Span(a, KINDS.index(kind), b, _score(text, kind, a, b)) for a, b in found.get(kind, ())]
    if some:
        further = {"iban": ibans(text), "ssn": ssns(text), "local": (m.span() for m in LOCAL.finditer(text)), "spaced": cards(text, SPACED)}
        for kind in FURTHER:
            for a, b in further[kind]:
                score = _score(text, kind, a, b)
                if score >= LEAST and not any(s.start < b and a < s.end for s in out):
                    out.append(Span(a, KINDS.index(kind), b, score))
    return sorted(out)


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").decode("utf-8", "replace")


def _scan(batches):
    for batch in batches:
        kept = [[{"start": s.start, "kind": KINDS[s.kind], "end": s.end, "score": s.score} for s in spans(t)] for t in _texts(batch.column(1))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, kind)], ["id", "found"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``found``: every span with its kind and score, by start, then kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(lean(_scan), f"id {docs.schema[id_col].dataType.simpleString()}, found {FOUND}")
    return out.withColumnRenamed("id", id_col)


def _mask(at: int):
    def run(batches):
        for batch in batches:
            column, out = batch.column(at), []
            for raw, text in zip(column, _texts(column), strict=True):
                parts, end = [], 0
                for s in spans(text):
                    if s.start >= end:
                        parts += [text[end : s.start], f"[{KINDS[s.kind].upper()}]"]
                    end = max(end, s.end)
                out.append(None if not raw.is_valid else text if not parts else "".join([*parts, text[end:]]))
            arrays = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind's name, as [EMAIL]; null texts stay null, other columns as they are."""
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(lean(_mask(docs.columns.index(text_col))), rows.schema)


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined), from ``find_pii``'s rows; n_further and scores beside."""
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_further"),
        F.transform("found", lambda s: s["score"]).alias("scores"),
    )
