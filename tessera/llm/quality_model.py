"""Quality classifier: ordinal cumulative-link regression over hashed text.

P(grade >= k) = sigmoid(w.x - threshold_k) with one weight vector for all grades and increasing
thresholds. x is the mean of a text's hashed word features. The model is fitted on at most ``most``
labelled rows (a documented bound) and scores all rows from a fixed-size weight array.

Grades come from ``labels``: 0 low quality, 1 good but toxic, 2 good. Selection keeps a document whose
tail probability P(grade >= 1) reaches ``keep_at``.

Edge cases: null and empty texts have x = 0 and get the prior; without labels every probability is 0.5 and all
is kept; a row without an id is scored as any other; extra columns are ignored; no rows give no rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.tasks import lean
from tessera.llm.hashed_text import DIMS, PER_WORD, gather, labelled_sample, sigmoid, word_features

MOST = 4000
SCALE = 10.0


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return sigmoid(z[:, None] - self.thresholds[None, :])


def _compact(buf, off):
    """Per row: feature, count, feature, count, ... and last the number of words."""
    row, f, words = word_features(buf, off)
    key, count = np.unique(row * DIMS + f, return_counts=True)
    ends = np.searchsorted(key, np.arange(len(off)) * DIMS)
    for i in range(len(off) - 1):
        a, b = ends[i], ends[i + 1]
        yield np.append(np.column_stack([key[a:b] - i * DIMS, count[a:b]]).ravel(), words[i])


def fit_ordinal(rows: list[tuple[int, np.ndarray]], grades: int, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-4) -> Ordinal:
    if not rows:
        return Ordinal(np.zeros(DIMS, np.float32), np.zeros(grades - 1))
    y = np.array([r[0] for r in rows])
    f = np.concatenate([r[1][:-1:2] for r in rows])
    x = np.concatenate([r[1][1:-1:2] * (SCALE / (PER_WORD * max(1, r[1][-1]))) for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) // 2 for r in rows])
    n, w, slack = len(y), np.zeros(DIMS), np.zeros(DIMS)
    tail = np.array([(np.count_nonzero(y >= k) + 1) / (n + 2) for k in range(1, grades)])
    first, gaps = -np.log(tail[0] / (1 - tail[0])), np.diff(-np.log(tail / (1 - tail)))
    raw = np.concatenate([[first], np.log(np.maximum(gaps, 1e-3))])  # thresholds stay ordered: gaps are exponentials
    raw_slack = np.zeros(len(raw))
    for _ in range(rounds):
        theta = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(doc, x * w[f], minlength=n)
        up = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - theta), np.zeros((n, 1))], axis=1)
        slope = up * (1 - up)
        p = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-9)
        lower, upper = slope[np.arange(n), y] / p / n, slope[np.arange(n), y + 1] / p / n
        g = -np.bincount(f, x * (lower - upper)[doc], minlength=DIMS) + ridge * w
        g_theta = np.array([(lower[y == k]).sum() - (upper[y == k - 1]).sum() for k in range(1, grades)])
        g_raw = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(raw[1:])])
        slack += g * g
        raw_slack += g_raw * g_raw
        w -= rate * g / np.sqrt(slack + 1e-12)
        raw -= rate * g_raw / np.sqrt(raw_slack + 1e-12)
    return Ordinal(w.astype(np.float32), raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> Ordinal:
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return fit_ordinal(gather(labelled_sample(docs, labels.where("quality is not null"), grade, most, id_col, text_col), _compact), 3)


def _score(model: Ordinal, keep_at: float):
    def run(batches):
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                row, f, words = word_features(buf, off)
                z = np.bincount(row, model.weights[f], minlength=b - a) * SCALE / (PER_WORD * np.maximum(1, words))
                p = model.tails(z)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(p[:, 0] >= keep_at)], ["id", "expected_grade", "p_grade_1", "p_grade_2", "kept"])

    return run


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """id, expected_grade, p_grade_1, p_grade_2 (tail probabilities) and kept."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(lean(_score(model, keep_at)), f"id {docs.schema[id_col].dataType.simpleString()}, expected_grade double, p_grade_1 double, p_grade_2 double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def _select(model: Ordinal, keep_at: float, at: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b, buf, off in X.blocks(batch.column(at)):
                row, f, words = word_features(buf, off)
                z = np.bincount(row, model.weights[f], minlength=b - a) * SCALE / (PER_WORD * np.maximum(1, words))
                keep.append(model.tails(z)[:, 0] >= keep_at)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return run


def select(docs: DataFrame, model: Ordinal, text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns."""
    return docs.mapInArrow(lean(_select(model, keep_at, docs.columns.index(text_col))), docs.schema)
