"""Chunkers: DataFrame -> one row per chunk."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import sums_before
from tessera.functions.text import sha256, strip, token_count, words

#: Strategy names, and the embedding models with their dimensions.
STRATEGIES = ("fixed", "sliding_window", "semantic")
MODELS = {"all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768, "e5-large-v2": 1024}


def check_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must lie in [0, size)")


@dataclass(frozen=True)
class ChunkConfig:
    """What a tenant may set for its files' chunks and vectors; refuses unknown names and values out of range."""

    model: str = "all-MiniLM-L6-v2"
    strategy: str = "fixed"
    size: int = 512
    overlap: int = 50
    max_chunks: int | None = None

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        check_window(self.size, self.overlap)
        if self.max_chunks is not None and self.max_chunks < 1:
            raise ValueError("max_chunks must be at least 1")

    @property
    def dims(self) -> int:
        return MODELS[self.model]


def _starts(n: Column, size: int, overlap: int) -> Column:
    """First words of the windows; the last window is the one that reaches the end."""
    return F.when(n > size, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array(F.lit(0)))


def chunk_simple(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 50, max_chunks: int | None = None) -> DataFrame:
    """Overlapping word windows; a text of at most ``size`` words stays as it is, one under ten characters goes.
    Texts are chunked to their end; ``max_chunks`` is for an embedding step that takes only so many of a file."""
    check_window(size, overlap)
    w = docs.where(F.length(strip(F.col(text_col))) >= 10).withColumn("__w", words(F.col(text_col)))
    starts = _starts(F.size("__w"), size, overlap)
    if max_chunks is not None:
        starts = F.slice(starts, 1, max_chunks)
    cut = w.select("*", F.posexplode(starts).alias("chunk_index", "__s"))
    content = F.when(F.size("__w") <= size, F.col(text_col)).otherwise(F.array_join(F.slice("__w", F.col("__s") + 1, F.lit(size)), " "))
    tokens = F.least(F.size("__w") - F.col("__s"), F.lit(size)).cast("long")
    return cut.withColumns({"content": content, "token_count": tokens}).withColumn("chunk_hash", sha256(F.col("content"))).drop("__w", "__s", text_col)


def chunk_fixed(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Word windows, always re-joined, with character offsets in the re-joined text."""
    check_window(size, overlap)
    step = size - overlap
    w = docs.withColumn("__w", words(F.col(text_col))).where(F.size("__w") > 0).withColumn("__at", _starts(F.size("__w"), size, overlap))
    # a window's first character follows the words before it and one blank for each of them
    per = F.transform("__at", lambda s: (F.length(F.array_join(F.slice("__w", s + 1, F.lit(step)), " ")) + 1).cast("long"))
    cut = w.select("*", F.posexplode(F.arrays_zip(F.col("__at").alias("s"), sums_before(per).alias("c"))).alias("chunk_index", "__x"))
    # re-joined, the words before a window end one blank earlier than it begins
    start = F.greatest(F.col("__x.c") - 1, F.lit(0).cast("long"))
    text = F.array_join(F.slice("__w", F.col("__x.s") + 1, F.lit(size)), " ")
    out = cut.withColumns({"content": text, "start_char": start, "token_count": F.least(F.size("__w") - F.col("__x.s"), F.lit(size)).cast("long")})
    return out.withColumn("end_char", F.col("start_char") + F.length("content")).drop("__w", "__at", "__x", text_col)


def chunk_sliding(docs: DataFrame, text_col: str = "text", size: int = 512, overlap: int = 100) -> DataFrame:
    return chunk_fixed(docs, text_col, size, overlap)


def chunk_semantic(docs: DataFrame, text_col: str = "text", size: int = 512) -> DataFrame:
    """Sentences (split at ". ") packed greedily up to ``size`` words; a longer sentence is a chunk of its own.
    Sentences are counted once, the walk over the counts keeps only where chunks begin, and each chunk is cut out once."""
    if size < 1:
        raise ValueError("size must be at least 1")
    split = docs.where(strip(F.col(text_col)) != "").withColumn("__p", F.split(F.col(text_col), r"\. "))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["i"] > 0) & (acc["n"] + n > size)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
            F.when(full, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"),
        )

    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("n"), F.array(F.lit(0)).alias("at"))
    begins = split.withColumn("__at", F.aggregate(F.transform("__p", token_count), zero, step, lambda acc: acc["at"]))
    cut = begins.select("*", F.posexplode("__at").alias("chunk_index", "__s"))
    end = F.coalesce(F.get("__at", F.col("chunk_index") + 1), F.size("__p"))
    content = F.concat(F.array_join(F.slice("__p", F.col("__s") + 1, end - F.col("__s")), ". "), F.lit("."))
    out = cut.withColumn("content", content)
    return out.withColumns({"token_count": token_count(F.col("content")), "start_char": F.lit(0).cast("long")}).drop("__p", "__at", "__s", text_col)


def chunk(docs: DataFrame, strategy: str = "fixed", **options) -> DataFrame:
    """By name; an unknown strategy means fixed windows (``ChunkConfig`` refuses one)."""
    return {"sliding_window": chunk_sliding, "semantic": chunk_semantic}.get(strategy, chunk_fixed)(docs, **options)
