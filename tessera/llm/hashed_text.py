"""Hashed text features from byte blocks, and the bounded sample of labelled rows that models fit on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.tasks import lean

DIMS = 1 << 18
PER_WORD = 4  # features
PREFIXES = (4, 5, 6, 7)
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Letters by case, digits and bytes over 127 are classes; every other byte is its own class.
CLASS = np.arange(256, dtype=np.uint64)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4


def letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, feature) of the runs of letters, A-Z lower-cased: the word and its first 4 to 7 bytes, where it is longer."""
    low = X.LOWER[buf]
    start, end, row = X.word_bounds(low, off, NOT_LETTER)
    roll = X.Rolling(low)
    starts, rows, marks = [start], [row], [roll.of(start, end)]
    for n in PREFIXES:
        longer = end - start > n
        starts.append(start[longer])
        rows.append(row[longer])
        with np.errstate(over="ignore"):
            marks.append(roll.of(start[longer], start[longer] + n) + np.uint64(n << 50))
    return np.concatenate(starts), np.concatenate(rows), (X.mix(np.concatenate(marks)) % np.uint64(DIMS)).astype(np.int64)


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, words of each row): hashed features of a word: itself, its outline, its ending's outline, and the text's length or if it repeats the word before."""
    start, end, row = X.word_bounds(buf, off)
    word = X.mix(X.Rolling(X.LOWER[buf]).of(start, end))
    c = CLASS[buf]
    with np.errstate(over="ignore"):
        size = np.minimum(end - start, 12).astype(np.uint64)
        outline = X.mix(c[start] + (c[np.minimum(start + 1, end - 1)] << np.uint64(8)) + (c[end - 1] << np.uint64(16)) + (size << np.uint64(24)) + np.uint64(1 << 40))
        ending = X.mix(c[end - 1] + (c[np.maximum(end - 2, start)] << np.uint64(8)) + (c[np.maximum(end - 3, start)] << np.uint64(16)) + np.uint64(2 << 40))
        words = np.bincount(row, minlength=len(off) - 1)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        size = np.minimum(6, np.log2(np.maximum(1, words)).astype(np.int64)).astype(np.uint64)[row]
        place = X.mix(np.where(again, np.uint64(99), size) + np.uint64(3 << 40))
    f = (np.concatenate([word, outline, ending, place]) % np.uint64(DIMS)).astype(np.int64)
    return np.tile(row, PER_WORD), f, words


def labelled_sample(docs: DataFrame, labels: DataFrame, target, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y) of at most ``most`` labelled rows, those with the smallest hashed ids; a repeated label counts by its largest."""
    y = labels.select(F.col(id_col).cast("long").alias("id"), target.cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    few = y.orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id")


def gather(rows: DataFrame, make, kind: str = "<i8") -> list[tuple[int, np.ndarray]]:
    """(y, array) for each sampled row; ``make(buf, off)`` yields one array of ``kind`` a row. The sample bounds what
    comes to the driver, a partition at a time."""

    def run(batches):
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.array([x.astype(kind).tobytes() for x in make(buf, off)], pa.binary())], ["id", "y", "x"])

    out = rows.select("text", "id", "y").mapInArrow(lean(run), "id long, y int, x binary").repartition("id").toLocalIterator()  # the shuffle lets all tasks run at once
    best: dict[int, tuple[int, bytes]] = {}
    for r in out:  # of rows that repeat an id the one with the largest features counts, whatever order they come in
        best[r.id] = max(best.get(r.id, (r.y, b"")), (r.y, bytes(r.x)))
    return [(y, np.frombuffer(x, kind)) for _, (y, x) in sorted(best.items())]


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))
