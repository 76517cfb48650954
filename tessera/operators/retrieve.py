"""From a question to its sources and an answer: encode, narrow to the tenant, nearest chunks, citations, text.

A search ranks only ids and distances; the texts and names of the few rows that win are joined afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators.chunk import MODELS
from tessera.operators.embed import encode_query
from tessera.operators.search import DISTANCES, SIMILARITIES, knn_batch, similar_enough
from tessera.operators.tenants import TenantView

#: The answer's opening, the answer without sources, and how answers are made.
OPENING, NOTHING = "Based on the documents: ", "No relevant information found in the documents."
METHOD = "extractive"
CITATION = ["chunk_id", "file_id", "filename", "chunk_index", "content", "token_count", "score", "metadata"]


@dataclass(frozen=True)
class SearchConfig:
    """What a request may set; refuses values out of range.

    ``threshold`` is the least similarity, by metric: 1 - distance for cosine, 1 / (1 + distance) for euclidean, and the
    product itself for dot, which is the only one that may lie outside 0..1."""

    k: int = 5
    threshold: float | None = None
    metric: str = "cosine"
    model: str = "all-MiniLM-L6-v2"

    def __post_init__(self):
        if not 1 <= self.k <= 20:
            raise ValueError("k must lie in 1..20")
        if self.metric not in DISTANCES:
            raise ValueError(f"unknown metric {self.metric}")
        if self.threshold is not None and self.metric != "dot" and not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in 0..1")
        if self.model not in MODELS:
            raise ValueError(f"unknown model {self.model}")


def check_query(query: str) -> str:
    """The query without outer blanks; empty ones and those over 2,000 characters are refused."""
    bare = query.strip()
    if not bare:
        raise ValueError("the query is empty")
    if len(query) > 2000:
        raise ValueError("a query has at most 2000 characters")
    return bare


def chunk_id() -> Column:
    return F.concat_ws(":", F.col("file_id").cast("string"), F.col("chunk_index").cast("string"))


def cited(hits: DataFrame, files: DataFrame, metric: str = "cosine") -> DataFrame:
    """Full citations of ranked chunks (file_id, chunk_index, distance, content, ...): chunk_id, filename, the score in 0..1
    (the metric's similarity, cut to that range) and a metadata map. Files join after the ranking, so that only its rows meet them."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), SIMILARITIES[metric](F.col("distance")))), 6)
    named = hits.join(files.select("file_id", "filename"), "file_id", "left")
    meta = F.create_map(F.lit("filename"), F.col("filename"), F.lit("chunk_index"), F.col("chunk_index").cast("string"))
    return named.withColumns({"chunk_id": chunk_id(), "score": score, "metadata": meta})


def of_model(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks whose vectors the model made: by ``embedding_model`` where the table has it, and of the model's length."""
    fit = chunks.where(F.size("embedding") == MODELS[model])
    return fit.where(F.col("embedding_model") == model) if "embedding_model" in chunks.columns else fit


def search(view: TenantView, chunks: DataFrame, files: DataFrame, query: str, config: SearchConfig | None = None) -> DataFrame:
    """The tenant's chunks nearest to the query with full citations, by rank.
    chunks: tenant_slug, file_id, chunk_index, content, token_count, embedding and, where several models are in use,
    embedding_model; vectors of another model or length take no part."""
    config = config or SearchConfig()
    asked = V.literal(encode_query(check_query(query), config.model))
    own = of_model(view.of(chunks), config.model)
    near = own.select("file_id", "chunk_index", F.round(DISTANCES[config.metric](F.col("embedding"), asked), 6).alias("distance")).where("distance is not null")
    if config.threshold is not None:
        near = near.where(similar_enough(config.metric, config.threshold))
    order = ["distance", "file_id", "chunk_index"]
    ranked = near.orderBy(*order).limit(config.k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    hits = ranked.join(view.of(chunks).select("file_id", "chunk_index", "content", "token_count"), ["file_id", "chunk_index"])
    return cited(hits, view.of(files), config.metric).select("rank", *CITATION).orderBy("rank")


def search_batch(chunks: DataFrame, queries: DataFrame, files: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """Many queries (query_id, query_vector, tenant_slug) against the chunks of their own tenants: query_id, rank and citations;
    ties go by chunk_id. ``chunks`` is read three times, so it should be a written table and not vectors still to be made."""
    config = config or SearchConfig()
    fit = of_model(chunks, config.model)
    ids = fit.select("tenant_slug", chunk_id().alias("chunk_id"), "embedding")
    won = knn_batch(ids, queries, config.k, ("tenant_slug",), config.metric, id_col="chunk_id").where("distance is not null")
    if config.threshold is not None:
        won = won.where(similar_enough(config.metric, config.threshold))
    texts = fit.select(chunk_id().alias("chunk_id"), "file_id", "chunk_index", "content", "token_count")
    hits = won.select("query_id", "rank", "distance", "chunk_id").join(texts, "chunk_id")
    return cited(hits, files, config.metric).select("query_id", "rank", *CITATION)


def answers(queries: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """One row per query_id, also for one without sources: its extractive answer (the first 200 characters of each of the
    best sources), n_sources, confidence and method."""
    best = sources.where(F.col("rank") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "content"))).alias("__s"))
    text = F.concat(F.lit(OPENING), F.array_join(F.transform("__s", lambda x: F.concat(F.substring(x["content"], 1, 200), F.lit("..."))), " "))
    found = F.coalesce(F.size("__s"), F.lit(0))
    some = F.col("__s").isNotNull()
    return queries.select("query_id").distinct().join(best, "query_id", "left").select(
        "query_id",
        F.when(some, text).otherwise(NOTHING).alias("answer"),
        F.when(some, found).otherwise(0).cast("long").alias("n_sources"),
        F.when(some, 0.8).otherwise(0.0).alias("confidence"),
        F.lit(METHOD).alias("method"),
    )


def ask(view: TenantView, chunks: DataFrame, files: DataFrame, query: str, config: SearchConfig | None = None) -> DataFrame:
    """One row: query, answer, n_sources, confidence, method, tenant_id and the cited sources."""
    found = search(view, chunks, files, query, config)
    sources = found.agg(F.sort_array(F.collect_list(F.struct("rank", *CITATION[:-1]))).alias("sources"))
    one = chunks.sparkSession.range(1).select(F.lit(query).alias("query_id"))
    text = answers(one, found.withColumn("query_id", F.lit(query)))
    return text.join(F.broadcast(sources)).select(F.col("query_id").alias("query"), "answer", "n_sources", "confidence", "method", F.lit(view.slug).alias("tenant_id"), "sources")  # one row each


def source_names(sources: DataFrame) -> DataFrame:
    """The distinct file names behind each query's sources, and their number."""
    names = sources.where("filename is not null").groupBy("query_id").agg(F.sort_array(F.collect_set("filename")).alias("filenames"))
    return names.withColumn("n_files", F.size("filenames").cast("long"))


def run_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per query of either run: how many chunks each found, how many both did, and the shared part of the larger set."""
    ids = lambda df, side: df.select("query_id", "chunk_id").distinct().withColumn(side, F.lit(True))
    both = ids(first, "a").join(ids(second, "b"), ["query_id", "chunk_id"], "full_outer")
    counts = both.groupBy("query_id").agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))
    return counts.withColumn("overlap", F.round(F.col("n_both") / F.greatest("n_first", "n_second"), 6))
