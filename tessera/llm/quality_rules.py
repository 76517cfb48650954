"""Quality rules by weak supervision, in DataFrame functions only.

Eight rules vote good (1), bad (-1) or abstain (0) on a text's counts. The votes' patterns are counted
over all rows (3^8 = 6561 at most come to the driver); expectation-maximisation on the counts estimates
how often each rule votes what on good and on bad texts, and Bayes' rule gives every text its posterior
probability of being good, which decides in place of demanding that every rule passes.

Edge cases: null and empty texts have no words and fail the base; an abstention is evidence too, so a text in which no rule
votes gets what all eight abstentions together say; rows without or with a repeated id are judged each; extra columns are ignored; no rows give no rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.native import let
from tessera.llm.scratch import stash

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_stops", "n_marks", "n_lettered")


def _repeat_words(h: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice: sort (hash, place), take equal neighbours, add up their cover."""

    def cover(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda s, x: s + x)

    def places(s: Column) -> Column:
        twin = F.transform(s, lambda e, j: F.when((F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]), e["p"]))
        return let(F.sort_array(F.filter(twin, lambda p: p.isNotNull())), cover)

    return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), places)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts that rules look at."""
    words = F.filter(F.split(F.col("__text"), BLANK), lambda w: w != "")
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*(F.get("__words", i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).withColumns({"__words": words, "__lines": lines})
    counted = base.select(
        "__id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count("__text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("__text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        F.regexp_count("__text", F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks"),
        F.size(F.filter("__words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_lettered"),
        hashes.alias("__h"),
    )
    repeated = F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("__h")))
    return counted.select("__id", *COUNTS[:-1], repeated.alias("n_repeat_words"), *MORE)


def _vote(bad: str, good: str) -> Column:
    return F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end")


#: A rule votes bad if the first condition holds, good if the second does. Each looks at evidence of its own and none at
#: the text's length, so that what the votes have in common is quality and not how long a text is.
RULES: dict[str, tuple[str, str]] = {
    "few_symbols": ("100 * n_symbols > 10 * n_words", "100 * n_symbols <= n_words"),
    "words_have_letters": ("100 * n_lettered < 75 * n_words", "100 * n_lettered >= 90 * n_words"),
    "few_marks": ("100 * n_marks > 11 * word_chars", "100 * n_marks <= 7 * word_chars"),
    "few_repeats": ("100 * n_repeat_words > 10 * n_words", "100 * n_repeat_words <= 2 * n_words"),
    "few_equal_lines": ("100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "word_length": ("10 * word_chars < 25 * n_words or 10 * word_chars > 90 * n_words", "word_chars >= 3 * n_words and word_chars <= 7 * n_words"),
    "few_capitals": ("100 * n_upper > 40 * word_chars", "100 * n_upper <= 12 * word_chars"),
    "sentences": ("100 * n_stops > 60 * n_words or (n_stops = 0 and n_words >= 40)", "n_stops > 0 and 100 * n_stops <= 30 * n_words"),
}


@dataclass(frozen=True)
class Votes:
    """log P(vote | good) - log P(vote | bad) per rule for votes -1, 0 and 1, and the prior's log odds."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]
    accuracies: tuple[float, ...]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> Votes:
    """Expectation-maximisation over (votes, count); starts from the share of good votes, abstentions apart."""
    m = len(RULES)
    if not patterns:
        return Votes(0.0, ((0.0, 0.0, 0.0),) * m, (0.5,) * m)
    post = []
    for votes, _ in patterns:
        cast = [v for v in votes if v]
        post.append(min(0.95, max(0.05, sum(v > 0 for v in cast) / len(cast))) if cast else 0.5)
    for _ in range(rounds):
        table = [[[1.0, 1.0, 1.0] for _ in range(m)] for _ in range(2)]
        size = [1.0, 1.0]
        for (votes, count), p in zip(patterns, post, strict=True):
            for side, share in ((0, 1 - p), (1, p)):
                size[side] += share * count
                for r, v in enumerate(votes):
                    table[side][r][v + 1] += share * count
        prior = math.log(size[1] / size[0])
        rate = [[[x / sum(t) for x in t] for t in side] for side in table]
        weights = tuple(tuple(math.log(g / b) for g, b in zip(rate[1][r], rate[0][r], strict=True)) for r in range(m))
        post = [1 / (1 + math.exp(-max(-500, min(500, prior + sum(weights[r][v + 1] for r, v in enumerate(votes)))))) for votes, _ in patterns]
    share = size[1] / (size[0] + size[1])
    right = tuple((share * rate[1][r][2] + (1 - share) * rate[0][r][0]) / max(1e-12, share * (rate[1][r][2] + rate[1][r][0]) + (1 - share) * (rate[0][r][0] + rate[0][r][2])) for r in range(m))
    return Votes(prior, weights, right)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """id, the five counts, base_failed, kept, posterior and each rule's vote."""
    counts = stash(text_counts(docs, id_col, text_col).withColumns({f"vote_{r}": _vote(*c) for r, c in RULES.items()}), "counts")
    names = [f"vote_{r}" for r in RULES]
    seen = counts.groupBy(*names).count().orderBy(*names).collect()
    votes = estimate([(tuple(r[n] for n in names), r["count"]) for r in seen])
    odds = F.lit(votes.prior)
    for n, w in zip(names, votes.weights, strict=True):
        odds = odds + F.when(F.col(n) < 0, w[0]).when(F.col(n) > 0, w[2]).otherwise(w[1])
    posterior = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select(F.col("__id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (posterior >= keep_at)).alias("kept"), posterior.alias("posterior"), *names)
