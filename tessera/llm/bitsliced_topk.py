"""Exact inner-product top-k on a bit-sliced index.

Vectors become integers floor(scale * x). A tile meets one block of the index with up to QUERIES queries, so that a
vector is sent, and its block's slices are built, once for QUERIES queries (more often only while there are fewer
tiles than cores). It keeps the upper slices of each attribute as bitmaps over its rows, adds them weighted by
the query's components with bitmap full adders, and walks the sum's slices from the most significant downward to
the k-th largest value. What the dropped slices can add bounds which rows may still win; only those boundary rows get exact
inner products. A tile passes on its best k a query, and a rank over the tiles' winners ends it.

Ties go to the smaller id. Vectors with components so large that sums may leave 64 bits stay out of the index and
are scored in Python's integers; a score among a tile's best that leaves 64 bits is an error. Vectors that are
null, empty, or hold a null or non-finite component take no part. Vectors meet vectors of their own
length. A query's own id is no candidate; rows that repeat an id are candidates each. Rows without an id
take no part; extra columns are ignored; no rows give no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tasks import lean

#: A block of the index holds about so many vectors, or so many components if that is less; a tile's queries.
ROWS, CELLS, QUERIES = 32_768, 1 << 22, 8_192
#: With fewer queries a tile is not divided to keep more cores busy.
FEW = 256
#: Slices kept of an attribute of usual width.
KEPT = 6


def _quantise(scale: float):
    def run(batches):
        for batch in batches:
            v = batch.column(1)
            n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = v.flatten()
            x = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n)])
            held = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[ends]) > 0
            ok = (n > 0) & ~held(~np.isfinite(x)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            # sums of n products of two such components stay under 2^62
            small = np.abs(x) < np.repeat(np.minimum(1 << 28, np.sqrt(2.0**62 / np.maximum(n, 1))), n)
            wide, short = held(~small), np.where(small, x, 0).astype("<i4")
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(2).take(pa.array(keep)), pa.array(n[keep].astype(np.int32)), pa.array([(x if wide[i] else short)[ends[i] : ends[i + 1]].tobytes() for i in keep], pa.binary())], ["id", "asks", "dims", "x"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    """Booleans over rows as 64-bit words."""
    words = -(-len(x) // 64)
    full = np.zeros(words * 64, bool)
    full[: len(x)] = x
    return np.packbits(full, bitorder="little").view(np.uint64)


class Index:
    """The upper slices of every attribute, each a bitmap over the rows."""

    def __init__(self, x: np.ndarray, low: int | None = None):
        """x: rows by attributes, int64. ``low``: how many lower slices are left out."""
        least, most = x.min(axis=0), x.max(axis=0)
        self.top = np.array([int(m).bit_length() for m in most - least], np.int64)
        self.low = low = max(0, int(np.median(self.top)) - KEPT) if low is None else low
        kept = [(d, b) for d, top in enumerate(self.top.tolist()) for b in range(low, top)]
        self.owner, self.place = np.array(kept, np.int64).reshape(-1, 2).T - [[0], [low]]
        self.all = _bits(np.ones(len(x), bool))
        self.slices = np.empty((len(kept), len(self.all)), np.uint64)
        for i, (d, b) in enumerate(kept):
            self.slices[i] = _bits(((x[:, d] - least[d]) >> b) & 1 > 0)

    def _sum(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum, least significant first. A negative weight adds the complement, which differs by a constant.

        Bitmaps of one significance stand in a column. Full adders take them by threes and leave one there and
        one in the next column, all threes of a column at once, until one is left."""
        weight = np.abs(q)[self.owner]
        flip = np.where(q < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[self.owner]
        took = [np.flatnonzero((weight >> j) & 1) for j in range(int(weight.max(initial=0)).bit_length())]
        rows = np.concatenate([*took, np.zeros(0, np.int64)])
        column = np.concatenate([*(self.place[t] + j for j, t in enumerate(took)), np.zeros(0, np.int64)])
        order = np.argsort(column, kind="stable")
        rows, ends = rows[order], np.cumsum(np.bincount(column))
        total: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        while len(total) < len(ends) or carried:
            c = len(total)
            own = rows[ends[c - 1] if c else 0 : ends[c]] if c < len(ends) else rows[:0]
            stack = np.concatenate([self.slices[own] ^ flip[own, None], *carried])
            carried = []
            while len(stack) > 2:
                n = len(stack) // 3
                x, y, z = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = x ^ y
                carried.append((x & y) | (half & z))
                stack = np.concatenate([half ^ z, stack[3 * n :]])
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            total.append(stack[0] if len(stack) else np.zeros_like(self.all))
        return total

    def candidates(self, q: np.ndarray, k: int, out: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best, without those in the bitmap ``out``."""
        rows = self.all & ~out
        if int(np.bitwise_count(rows).sum()) > k:
            total, tie, need, kth = self._sum(q), rows, k, 0
            for b in range(len(total) - 1, -1, -1):
                high = tie & total[b]
                have = int(np.bitwise_count(high).sum())
                kth *= 2
                if have >= need:
                    tie, kth = high, kth + 1
                else:
                    need, tie = need - have, tie & ~total[b]
            # what the dropped slices of every row can add, in units of the kept ones
            slack = int(np.abs(q) @ ((1 << np.minimum(self.low, self.top)) - 1))
            least = kth - -(-slack // (1 << self.low))
            if least > 0:
                over, same = np.zeros_like(rows), rows
                for b in range(len(total) - 1, -1, -1):
                    if (least >> b) & 1:
                        same = same & total[b]
                    else:
                        over, same = over | (same & total[b]), same & ~total[b]
                rows = over | same
        return np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))


def _read(column: pa.ChunkedArray, dims: int):
    """Positions and int64 rows of the vectors in four-byte integers, and positions and rows of Python's integers of the others."""
    raw = column.to_pylist()
    short = np.array([len(r) == 4 * dims for r in raw], bool)
    x = np.frombuffer(b"".join(r for r in raw if len(r) == 4 * dims), "<i4").reshape(-1, dims).astype(np.int64)
    wide = np.array([[int(v) for v in np.frombuffer(r, "<f8").tolist()] for r in raw if len(r) != 4 * dims], object).reshape(-1, dims)
    return np.flatnonzero(short), x, np.flatnonzero(~short), wide


def _tile(k: int):
    def run(key, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        qi, si, sc = [], [], []
        if vectors.num_rows and asked.num_rows:
            dims = key[0].as_py()
            ids, queries = vectors.column("id").to_numpy(), asked.column("asked_id").to_numpy()
            at_x, x, at_wide, wide = _read(vectors.column("x"), dims)
            at_q, q_short, at_q_wide, q_wide = _read(asked.column("asked_x"), dims)
            index = Index(x) if len(x) else None
            x = x.astype(np.int32)
            for query, q, fits in [*zip(queries[at_q].tolist(), q_short, [True] * len(at_q)), *zip(queries[at_q_wide].tolist(), q_wide, [False] * len(at_q_wide))]:
                own = ids[at_x] == query
                at = np.flatnonzero(~own) if index is None or not fits else index.candidates(q, k, _bits(own))
                score = x[at].astype(np.int64 if fits else object) @ q
                at = at_x[at]
                if len(at_wide):
                    more = np.flatnonzero(ids[at_wide] != query)
                    score = np.concatenate([score.astype(object), wide[more] @ q.astype(object)])
                    at = np.concatenate([at, at_wide[more]])
                if score.dtype == object:
                    best = np.array(sorted(range(len(at)), key=lambda i: (-score[i], ids[at[i]]))[:k], np.int64)  # noqa: B023
                    if any(not -(1 << 63) <= score[i] < 1 << 63 for i in best):
                        raise OverflowError(f"a score of query {query} leaves 64 bits")
                else:
                    best = np.lexsort((ids[at], -score))[:k]
                qi += [query] * len(best)
                si += ids[at[best]].tolist()
                sc += score[best].tolist()
        return pa.table({"query_id": pa.array(qi, pa.int64()), "id": pa.array(si, pa.int64()), "score": pa.array(sc, pa.int64())})

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k best rows for each row that ``queries`` selects. The id has its column's name, or
    "candidate" where that is one of the other three."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    ready = rows.select("id", "v", "asks").mapInArrow(lean(_quantise(scale)), "id long, asks boolean, dims int, x binary")
    n, m, cells = ready.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    blocks = max(1, -(-n // ROWS), -(-cells // CELLS))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    asked = max(1, -(-m // QUERIES), min(-(-m // FEW), -(-cores // blocks)))
    left = ready.select("dims", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("ask"), "id", "x")
    ask = ready.where("asks").dropDuplicates(["id"])
    right = ask.select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64(F.col("id") + 1), F.lit(asked)).cast("int").alias("ask"), F.col("id").alias("asked_id"), F.col("x").alias("asked_x"))
    by = ["dims", "block", "ask"]
    won = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_tile(k), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    name = "candidate" if id_col in ("query_id", "rank", "score") else id_col
    return won.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(name), "score")
