"""Vector code compression: product codes of integer vectors, with exact distances behind lower bounds.

A vector's components become floor(256 * x) and the vector is cut into PARTS equal parts. Each part's codebook starts
as that part of the first ENTRIES vectors; a round assigns every part to its nearest entry and moves the entries to
their parts' means. Distances to all entries are not worked out: a part's and an entry's block means and residual
norms bound their distance from below,

    |x - c|^2  >=  sum over blocks of  size * (mean x - mean c)^2 + (|x - mean x| - |c - mean c|)^2,

first with one block, then with twice as many at each level. Entries whose bound lies above an exact distance that is
known already go; the bound is lowered by more than its rounding error, so none that could be nearest does. What is
left is decided by exact integer distances, ties by the lower entry.

Each round is one pass over the table: a task sends one sum and count for each entry's component, so what meets on the
driver is a codebook's size (ENTRIES vectors), whatever the table holds.

Edge cases: vectors that are null or hold null or non-finite components are dropped; with fewer than ENTRIES vectors the
codebooks are shorter; rows that repeat an id are coded each, and seed in the order of id, then components; a null id
comes last; equal parts tie to the lower entry; vectors whose length is not the most common one (of equally common ones
the longest) cannot be coded and are returned with null code and errors; a length that PARTS does not divide is an error;
components of any finite size are exact, and an error beyond 64 bits is an error; extra columns are ignored; no rows give
no rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import stash
from tessera.llm.tasks import lean

PARTS, ENTRIES, ROUNDS = 16, 64, 2
ROWS = 2048  # vectors worked on at a time
SALTS = 32  # a label's rows meet their sum in so many places
SLACK = 1e-9  # of the squared norms; far above the bounds' rounding error

Codebooks = list[list[list[int]]]  # part, entry, component


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, means, residual norms) of n consecutive blocks of each row."""
    cut = np.linspace(0, x.shape[1], n + 1).astype(int)
    size = np.diff(cut)
    mean = np.add.reduceat(x, cut[:-1], axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return size, mean, np.sqrt(np.add.reduceat(rest * rest, cut[:-1], axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row of integers."""
    n, width = x.shape
    if not width:
        return np.zeros(n, int), np.zeros(n, int)
    most = math.isqrt((1 << 61) // width)  # squares of differences then fit 64 bits
    if x.dtype == object or entries.dtype == object or max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) > most:
        d = ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
        at = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], int)
        return at, d[np.arange(n), at]
    xf, cf = x.astype(float), entries.astype(float)
    slack = SLACK * ((xf * xf).sum(axis=1)[:, None] + (cf * cf).sum(axis=1)) + 1e-6

    size, mx, rx = _blocks(xf, 1)
    _, mc, rc = _blocks(cf, 1)
    low = size[0] * (mx - mc.T) ** 2 + (rx - rc.T) ** 2 - slack
    first = low.argmin(axis=1)
    known = ((x - entries[first]) ** 2).sum(axis=1)  # exact, so no entry beyond it is nearest
    row, col = np.nonzero(low <= known[:, None])
    count = 2
    while count < width and len(row) > n:
        size, mx, rx = _blocks(xf, count)
        _, mc, rc = _blocks(cf, count)
        low = ((mx[row] - mc[col]) ** 2 * size + (rx[row] - rc[col]) ** 2).sum(axis=1) - slack[row, col]
        keep = low <= known[row]
        row, col = row[keep], col[keep]
        count *= 2
    d = ((x[row] - entries[col]) ** 2).sum(axis=1)
    begin = np.searchsorted(row, np.arange(n))  # every row keeps its first
    least = np.minimum.reduceat(d, begin) if n else d
    hit = np.flatnonzero(d == least[row])
    hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])[: len(hit)]]  # columns rise, so the first is the lower entry
    return col[hit], least


def _integers(column: pa.Array, width: int) -> np.ndarray:
    scaled = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(column), width)
    if np.abs(scaled).max(initial=0) < 1 << 52:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in r] for r in scaled.tolist()], object).reshape(scaled.shape)


def _arrays(books: Codebooks) -> list[np.ndarray]:
    big = any(abs(v) >= 1 << 62 for part in books for entry in part for v in entry)
    return [np.array(part, object if big else np.int64) for part in books]


def _assigned(column: pa.Array, width: int, books: list[np.ndarray]):
    """For ROWS vectors at a time: their place, components, and (entry, distance) of each part."""
    step = width // PARTS
    for lo in range(0, len(column), ROWS):
        x = _integers(column.slice(lo, ROWS), width)
        yield lo, x, [nearest(x[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)]


def _moves(width: int, books: Codebooks):
    """Per task: (part, entry, position, total, n) of the parts assigned to each entry."""
    step = width // PARTS

    def run(batches):
        held, total, n = _arrays(books), np.zeros((PARTS, len(books[0]), step), object), np.zeros((PARTS, len(books[0])), np.int64)
        for batch in batches:
            for _, x, found in _assigned(batch.column(0), width, held):
                for p, (entry, _) in enumerate(found):
                    n[p] += np.bincount(entry, minlength=len(books[0]))
                    order = np.argsort(entry, kind="stable")
                    used, begin = np.unique(entry[order], return_index=True)
                    total[p, used] += np.add.reduceat(x[order, p * step : (p + 1) * step], begin, axis=0).astype(object)
        part, entry = np.nonzero(n)
        if len(part):
            each = [np.repeat(v, step) for v in (part, entry)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in each), pa.array(np.tile(np.arange(step, dtype=np.int32), len(part))), pa.array([str(v) for v in total[part, entry].ravel()], pa.string()), pa.array(np.repeat(n[part, entry], step))], ["part", "entry", "position", "total", "n"])

    return run


def _codes(width: int, books: Codebooks):
    def run(batches):
        held = _arrays(books)
        for batch in batches:
            for lo, x, found in _assigned(batch.column(0), width, held):
                entry = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = sum(f[1] for f in found)
                code = [r.tobytes().hex() for r in entry]
                rest = [batch.column(i).slice(lo, len(x)) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())], ["id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite, as doubles."""
    rows = vectors.withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    return rows.where(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))  # NaN counts as the largest


def train(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of vectors of one length."""
    if width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    step = width // PARTS
    first = vectors.orderBy(F.asc_nulls_last(id_col), vector_col).select(vector_col).limit(entries).collect()
    seeds = [[math.floor(256 * v) for v in r[0]] for r in first]
    books = [[s[p * step : (p + 1) * step] for s in seeds] for p in range(PARTS)]
    for _ in range(rounds if step else 0):
        moved = vectors.select(vector_col).mapInArrow(lean(_moves(width, books)), "part int, entry int, position int, total string, n long")
        sums = moved.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # a codebook's size
            books[r.part][r.entry][r.position] = int(r.total) // r.n
    return books


def encode(vectors: DataFrame, width: int, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance to what the code stands for)."""
    kind = lambda c: vectors.schema[c].dataType.simpleString()
    rows = vectors.select(vector_col, F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    return rows.mapInArrow(lean(_codes(width, books)), f"id {kind(id_col)}, label {kind(label_col)}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Adds ``vector``: the integer components that each code stands for."""
    held = F.array(*(F.array(*(F.array(*(F.lit(v).cast("long") for v in entry)) for entry in part)) for part in books))
    index = lambda p: (F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int"))
    return codes.withColumn("vector", F.when(F.col(code_col).isNotNull(), F.flatten(F.array(*(F.get(F.get(held, F.lit(p)), index(p)) for p in range(len(books)))))))


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error (the errors' sum over equal labels, nulls together) and codebooks_sha256."""
    rows = usable(vectors.select(id_col, vector_col, label_col), vector_col)
    size = F.size(vector_col)
    widest = rows.groupBy(size.alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = widest[0]["width"] if widest else 0
    fit = rows.where(size == width)
    books = train(fit, width, id_col, vector_col)
    coded = encode(fit, width, books, id_col, vector_col, label_col)
    odd = rows.where(size != width).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stash(coded.unionByName(odd), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")) & (salted["salt"] == sums["salt"]))
    return met.select(F.col("id").alias(id_col), "code", "error", F.when(F.col("code").isNotNull(), F.col("label_error")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
