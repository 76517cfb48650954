"""Source divergence audit: how far a source's words lie from those of its language's other sources.

Plain relational work: regular-expression matches are exploded and counted per language, source and term; a language
keeps the terms that enough of its documents hold; its groups are crossed with these, so that a term which a group
lacks counts as zero; sources meet on (language, term), and differences are summed and ranked.

A share is 1 + floor(SCALE * (count + 5) / (all counts + 5 * terms)), in decimals, so it is exact at any size.

Edge cases: null text, language and source count as ''; a group without terms has all shares from the 5 alone; a
language that keeps no term still pairs its sources, with value 0; a language with one source has no pair; rows that
repeat an id are documents of their own (no id is read); extra columns are ignored; no rows give no rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import stash

#: Letters of ASCII and every character beyond it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 30  # documents of a language that must hold a term
MOST = 50  # ranks of terms that are kept
SCALE = 10**9
SALTS = 32  # parts of a language's vocabulary, so that a large language is not crossed in one task


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, held): occurrences of a term, and documents that hold it."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    low = F.translate(plain(text_col), string.ascii_uppercase, string.ascii_lowercase)
    each = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.regexp_extract_all(low, F.lit(TERM), F.lit(0)).alias("terms"))
    count = lambda terms, n, held: F.struct(F.col(terms).alias("terms"), F.lit(n).alias("n"), F.lit(held).alias("held"))
    twice = each.withColumn("once", F.array_distinct("terms")).select("lang", "source", F.explode(F.array(count("terms", 1, 0), count("once", 0, 1))).alias("x"))
    exploded = twice.select("lang", "source", F.explode("x.terms").alias("term"), "x.n", "x.held")
    return exploded.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def _share(n: str, total: str, terms: str) -> Column:
    return F.expr(f"1 + (cast({n} + 5 as decimal(20,0)) * {SCALE}) div cast({total} + 5 * {terms} as decimal(20,0))")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language by summed difference of
    shares; part ``term``: the ``most`` terms whose share in the source exceeds the language's by most."""
    per = Window.partitionBy("lang", "term")
    known = term_counts(docs, text_col, lang_col, source_col).withColumn("spread", F.sum("held").over(per)).where(F.col("spread") >= least)
    kept = stash(known.select("lang", "source", "term", "n", F.sum("n").over(per).alias("lang_n")), "kept")

    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    sized = stash(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total"))), "groups")

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    crossed = sized.withColumn("salt", every).join(vocabulary.select("lang", "term", salt.alias("salt")), ["lang", "salt"])
    dense = crossed.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", zero))
    shares = stash(dense.select("lang", "term", "source", _share("n", "total", "terms").alias("p")), "shares")
    apart = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "term"]).where("source < item")
    sums = apart.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    bare = sized.where("terms = 0").select("lang", "source")
    equal = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", zero)
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    both = sums.unionByName(equal).select("lang", F.explode(F.array(way("source", "item"), way("item", "source"))).alias("x"), "value").select("lang", "x.*", "value")

    against = kept.join(sized, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total", "terms").alias("p"), _share("lang_n", "lang_total", "terms").alias("q"))
    over = against.where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(_ranked(both), "pair").unionByName(columns(_ranked(over).where(F.col("rank") <= most), "term"))
