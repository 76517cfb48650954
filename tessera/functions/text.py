"""Text columns: Unicode white space, words, decoding, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that separate words (Unicode white space and the four information separators).
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_INSIDE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# printable ASCII fails at the first range, before the class is looked through
GAP = rf"(?:(?![!-~])[{_INSIDE}])+"
WORD = rf"(?:[!-~]|[^{_INSIDE}])+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Words between runs of white space; an empty array for blank or null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def token_count(text: Column) -> Column:
    """The number of words, without building them; 0 for a null text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def decode(content: Column, trim: bool = True) -> Column:
    """UTF-8 without its bad bytes, newlines as \\n; with ``trim`` also stripped, and empty below ten characters."""
    text = F.regexp_replace(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")), "\r\n?", "\n")
    if not trim:
        return text
    bare = strip(text)
    return F.when(F.length(bare) < 10, "").otherwise(bare)


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def contains_word(text: Column, word: str) -> Column:
    return F.lower(text).contains(word.lower())


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 1)


def shortened(text: Column, most: int = 100) -> Column:
    """At most ``most`` characters, the last three of a shortened text dots."""
    if most < 4:
        raise ValueError("at least four characters")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


#: The marks of a file's state.
MARKS = {"synced": "✅", "pending": "⏳", "processing": "🔄", "failed": "❌"}


def status_mark(status: Column) -> Column:
    marks = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    return F.coalesce(F.try_element_at(marks, status), F.lit("❓"))


def merged(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key the second's value counts. A null map counts as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first, none), F.coalesce(second, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def iso(at: Column) -> Column:
    """ISO 8601 in the session's time zone, Z for UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def listed(text: Column) -> Column:
    """The trimmed entries of a comma-separated list."""
    return F.transform(F.split(text, ","), strip)
