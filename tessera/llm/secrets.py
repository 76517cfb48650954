"""Secret scans, in DataFrame functions only.

Patterns find assignments, access keys and long hex strings. Beside them, every run of at least WINDOW
key characters is a candidate: a window slides over it, the entropy is kept up from the counts of the
character that leaves and of the one that enters, and the candidate is a secret if its largest window
entropy reaches the threshold of its character class. The allow list suppresses the parts of a candidate,
between / = _ and -, that it matches; what is left between them is a candidate of its own.

Spans are code points, end exclusive. Edge cases: null counts as empty; texts without a find have empty
spans; a text may be found under several kinds; rows with a repeated or null id are scanned each; extra
columns are ignored; no rows give no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.native import let, match_spans

WINDOW = 20
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
#: Least window entropy in bits, by character class. Of 20 characters it is at most 4.32, of ten digits 3.32.
BITS = {"digits": 3.1, "hex": 3.0, "letters": 3.9, "mixed": 3.9}
ALLOWED = r"(?i)example|dummy|placeholder|sample|lorem|0123456789|abcdefgh|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: What such a candidate still holds: separators and whole parts without an allowed word.
UNLISTED = r"(?:[/=_-]|(?<![A-Za-z0-9+])(?!(?i:[A-Za-z0-9+]*(?:example|dummy|placeholder|sample|lorem|0123456789|abcdefgh)))[A-Za-z0-9+]++)++"
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _nlogn(n: Column) -> Column:
    return F.when(n < 2, F.lit(0.0)).otherwise(n * F.log2(F.greatest(n, F.lit(1)).cast("double")))


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of ``window`` characters; null for shorter strings.

    The state is the count of each of the value's distinct characters in the window: a step takes one from the
    character that leaves, adds one to the one that enters, and moves sum(n log n) by what these two change."""

    def slide(chars: Column) -> Column:
        def over(known: Column) -> Column:
            codes = F.transform(chars, lambda c: F.array_position(known, c).cast("int"))

            def along(code: Column) -> Column:
                head = F.slice(code, F.lit(1), F.lit(window))
                counts = F.transform(F.sequence(F.lit(1), F.size(known)), lambda k: F.size(F.filter(head, lambda c: c == k)))
                moves = F.zip_with(F.slice(code, F.lit(1), F.size(code) - window), F.slice(code, F.lit(window + 1), F.size(code)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

                def step(acc: Column, m: Column) -> Column:
                    n, k = F.element_at(acc["n"], m["a"]), F.element_at(acc["n"], m["b"])
                    total = acc["sum"] - _nlogn(n) + _nlogn(n - 1) - _nlogn(k) + _nlogn(k + 1)
                    moved = F.transform(acc["n"], lambda x, i: x - (i + 1 == m["a"]).cast("int") + (i + 1 == m["b"]).cast("int"))
                    changed = let(total, lambda t: F.struct(moved.alias("n"), t.alias("sum"), F.least(acc["low"], t).alias("low")))
                    return F.when(m["a"] == m["b"], acc).otherwise(changed)

                def fold(n: Column) -> Column:
                    first = F.aggregate(n, F.lit(0.0), lambda s, x: s + _nlogn(x))
                    return let(first, lambda s: F.aggregate(moves, F.struct(n.alias("n"), s.alias("sum"), s.alias("low")), step, lambda acc: F.lit(math.log2(window)) - acc["low"] / window))

                return let(counts, fold)

            return let(codes, along)

        return let(F.array_distinct(chars), over)

    return F.when(F.length(value) >= window, let(F.split(value, ""), slide))


def least_bits(value: Column) -> Column:
    """The threshold of a candidate's class: digits, hex, letters alone, or a mixture with digits; null for any other."""
    letters = value.rlike("[a-z]") & value.rlike("[A-Z]")
    return F.when(value.rlike("^[0-9]+$"), BITS["digits"]).when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & value.rlike("[0-9]"), BITS["hex"]).when(
        value.rlike("[0-9]") & value.rlike("[A-Za-z]"), BITS["mixed"]).when(~value.rlike("[0-9]") & letters, BITS["letters"])


def _suspicious(value: Column) -> Column:
    return ~value.rlike(ALLOWED) & (window_entropy(value) >= least_bits(value))


def _candidates(span: Column) -> Column:
    """The span or, where the allow list matches in it, what lies between the matched parts."""
    rest = F.filter(match_spans(span["value"], UNLISTED), lambda p: ~F.regexp_replace(p["value"], "^[/=_-]+|[/=_-]+$", "").rlike(ALLOWED))
    moved = F.transform(rest, lambda p: F.struct((span["start"] + p["start"]).alias("start"), (span["start"] + p["end"]).alias("end"), p["value"].alias("value")))
    return F.when(span["value"].rlike(ALLOWED), moved).otherwise(F.array(span))


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"))).cast(_SPAN)


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds __assign, __access, __hex and __entropy."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({
        "__assign": _kind(F.filter(match_spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6), "assign"),
        "__access": _kind(match_spans(text, ACCESS), "access"),
        "__hex": _kind(match_spans(text, HEX), "hex"),
        "__entropy": _kind(F.filter(F.flatten(F.transform(match_spans(text, CANDIDATE), _candidates)), lambda s: _suspicious(s["value"])), "entropy"),
    })


def _written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans (kind:start:end, comma-joined)."""
    found = _with_spans(docs.select(id_col, text_col), text_col)
    return found.select(
        id_col,
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_written(F.concat("__assign", "__access", "__hex")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("__assign", "__access", "__hex", "__entropy")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (n_chars, where there is one, is counted anew)."""
    found = _with_spans(docs, text_col).withColumn("__all", F.array_sort(F.concat("__assign", "__access", "__hex", "__entropy")))

    def step(acc: Column, s: Column) -> Column:
        text = F.col(text_col)
        more = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__all", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), (acc["at"] + 1).cast("int"), F.length(text_col))))
    new = {"__masked": F.when(F.size("__all") > 0, masked)}
    out = found.withColumns(new)
    over = {text_col: F.coalesce("__masked", text_col)}
    if "n_chars" in docs.columns:
        over["n_chars"] = F.when(F.col("__masked").isNull(), F.col("n_chars")).otherwise(F.length("__masked").cast(docs.schema["n_chars"].dataType))
    return out.withColumns(over).select(*docs.columns)
