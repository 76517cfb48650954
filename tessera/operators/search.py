"""Nearest neighbours, citations and extractive answers."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vector as V

DISTANCES = {
    "cosine": V.cosine_distance,
    "dot": lambda a, b: -V.dot(a, b),
    "euclidean": V.euclidean,
}
#: Similarity by metric, from its distance: larger is nearer.
SIMILARITIES = {
    "cosine": lambda distance: 1 - distance,
    "dot": lambda distance: -distance,
    "euclidean": lambda distance: 1 / (1 + distance),
}
ROWS, QUERIES = 16_384, 4_096  # of a tile
PAIRS = 1 << 16  # distances of a tile that are worked out at a time


def similar_enough(metric: str, threshold: float) -> Column:
    """Whether ``distance`` means a similarity of at least ``threshold``."""
    return SIMILARITIES[metric](F.col("distance")) >= threshold


def knn(vectors: DataFrame, query: Column, k: int = 10, metric: str = "cosine", threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """The k rows nearest to one query vector, ties by id. ``threshold`` keeps similarities, of the metric's own kind, of at least that."""
    scored = vectors.withColumn("distance", F.round(DISTANCES[metric](F.col(vector_col), query), digits))
    if threshold is not None:
        scored = scored.where(similar_enough(metric, threshold))
    return scored.drop(vector_col).orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def _padded(column: pa.ChunkedArray):
    """Components with zeros up to the longest vector's length, each vector's length, and whether it and they are not null."""
    v = column.combine_chunks()
    n, flat = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), v.flatten()
    inside = np.arange(n.max(initial=0)) < n[:, None]
    x, null = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    x[inside], null[inside] = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    return x, n, v.is_valid().to_numpy(zero_copy_only=False) & ~null.any(axis=1)


def _distances(metric: str, x: np.ndarray, y: np.ndarray):
    """Distances of each y to each x, and where they are null. Sums run over the components in order, as in ``DISTANCES``."""
    total, part, nothing = np.zeros((len(y), len(x))), np.empty((len(y), len(x))), np.zeros((len(y), len(x)), bool)
    norm = lambda m: np.sqrt(sum((c * c for c in m.T), np.zeros(len(m))))
    for a, b in zip(np.ascontiguousarray(x.T), y.T, strict=True):
        if metric == "euclidean":
            np.subtract(a, b[:, None], out=part)
            part *= part
        else:
            np.multiply(a, b[:, None], out=part)
        total += part
    if metric == "euclidean":
        return np.sqrt(total), nothing
    if metric == "dot":
        return -total, nothing
    scale = norm(y)[:, None] * norm(x)
    return 1 - total / np.where(scale == 0, 1, scale), scale == 0


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the shortest decimal form, as Spark's round."""
    values, at = np.unique(d, return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    with localcontext(prec=400):
        return np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) if np.isfinite(v) else v for v in values.tolist()])[at]


def _tile(k: int, metric: str, digits: int, names: list[str]):
    def run(key, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        qi, vi, dist, null = ([np.zeros(0, t)] for t in (np.int64, np.int64, float, bool))
        if vectors.num_rows and asked.num_rows:
            (x, xn, xs), (y, yn, ys) = _padded(vectors.column("__v")), _padded(asked.column("__q"))
            wide = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, y))
            place = np.empty(len(x), np.int64)
            place[pc.sort_indices(vectors.select(["__id"]), sort_keys=[("__id", "ascending")], null_placement="at_start")] = np.arange(len(x))
            step = max(1, PAIRS // len(x))
            for lo in range(0, len(y), step):
                with np.errstate(all="ignore"):
                    d, none = _distances(metric, x, y[lo : lo + step])
                none |= ~(xs & ys[lo : lo + step, None]) | (xn != yn[lo : lo + step, None])
                late = none | np.isnan(d)
                open_ = np.where(late, np.inf, d)
                # whatever can round to the k-th distance or below
                least = np.partition(open_, k - 1, axis=1)[:, k - 1] + 2 * 10.0**-digits if len(x) > k else np.full(len(d), np.inf)
                for i in range(len(d)):
                    at = np.flatnonzero(open_[i] <= least[i])
                    r = _rounded(open_[i, at], digits)
                    best = np.lexsort((place[at], r, late[i, at].astype(int) + none[i, at]))[:k]
                    at, r = at[best], r[best]
                    qi.append(np.full(len(at), lo + i))
                    vi.append(at)
                    dist.append(np.where(late[i, at], np.nan, r))
                    null.append(none[i, at])
        columns = asked.column("__query").take(pa.array(np.concatenate(qi))), vectors.column("__id").take(pa.array(np.concatenate(vi)))
        return pa.table([*columns, pa.array(np.concatenate(dist), mask=np.concatenate(null), from_pandas=False)], names=names)

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, by: Sequence[str] = (), metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, vec_id, distance, rank) for a stated set of queries (query_id, query_vector, *by) against all
    vectors; ``by`` names columns that both sides must share, such as a tenant.

    Tiles of about ROWS vectors and QUERIES queries each pass on the k best of a query, so that what is ranked
    at last grows with queries and blocks, not with pairs."""
    known = [F.col(c).isNotNull() for c in by]
    for c in known:
        vectors, queries = vectors.where(c), queries.where(c)
    blocks, asks = max(1, -(-vectors.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(*by, block(blocks, id_col, vector_col).alias("__block"), every(asks).alias("__ask"), F.col(id_col).alias("__id"), F.col(vector_col).cast("array<double>").alias("__v"))
    right = queries.select(*by, every(blocks).alias("__block"), block(asks, "query_id", "query_vector").alias("__ask"), F.col("query_id").alias("__query"), F.col("query_vector").cast("array<double>").alias("__q"))
    on = [*by, "__block", "__ask"]
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    won = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_tile(k, metric, digits, kinds.names), kinds)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), id_col))
    return won.withColumn("rank", rank).where(F.col("rank") <= k)


def citations(top: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the file's name after the top-k, so that only its rows meet the file table."""
    return top.join(files.select("file_id", "filename"), "file_id")


def validate_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    from tessera.functions.text import strip, token_count

    q = F.coalesce(F.col(query_col), F.lit(""))
    ok = F.length(strip(q)) > 0
    return queries.withColumns({"is_valid": ok, "length": F.length(q).cast("long"), "word_count": token_count(q), "status": F.when(ok, "valid").otherwise("empty")})


def metadata_filter(docs: DataFrame, equals: dict[str, object] | None = None, any_of: dict[str, Sequence[object]] | None = None, between: dict[str, tuple[object, object]] | None = None) -> DataFrame:
    """Conjunction of the optional predicates that are given."""
    for c, v in (equals or {}).items():
        docs = docs.where(F.col(c) == v)
    for c, v in (any_of or {}).items():
        docs = docs.where(F.col(c).isin(*v))
    for c, (low, high) in (between or {}).items():
        docs = docs.where(F.col(c).between(low, high))
    return docs


def page(df: DataFrame, key: Sequence[str], number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size in 1..100")
    return df.orderBy(*key).offset((number - 1) * size).limit(size)
