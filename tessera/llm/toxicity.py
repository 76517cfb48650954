"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's probability is a logistic function of the sum of its
words' weights, and the document's is their noisy-or, 1 - prod(1 - p). Only document labels train it;
the sentences that carry a document's score are then located. Words that fewer than ``SEEN`` sampled
documents hold get no weight. Fitted on at most ``most`` labelled rows (a documented bound).

Edge cases: null and empty texts have no sentence and score 0; without labels, or with one class only, all
scores are near the prior; a row without an id counts as held out; extra columns are ignored; no rows
give no rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bytesx as X
from tessera.llm.tasks import lean
from tessera.llm.hashed_text import DIMS, gather, labelled_sample, letters, sigmoid

MOST = 8000
SEEN = 4
SLICE = 1 << 19  # features at a time in training
FIRST = np.uint32(1 << 31)
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Bags:
    weights: np.ndarray
    bias: float


def sentences(buf: np.ndarray, off: np.ndarray):
    """(start, end, row) of the sentences with a letter, and (sentence, feature) of their words."""
    start, end, row = X.word_bounds(buf, off, STOP)
    at, _, f = letters(buf, off)
    of = np.searchsorted(start, at, "right") - 1
    live, of = np.unique(of, return_inverse=True)
    return start[live], end[live], row[live], of, f


def _compact(buf, off):
    """Per row: each sentence's distinct features, the first of them with ``FIRST`` added."""
    _, _, row, of, f = sentences(buf, off)
    key = np.unique(of * DIMS + f)
    of, f = key // DIMS, (key % DIMS).astype(np.uint32)
    f[np.append(True, of[1:] != of[:-1])[: len(f)]] |= FIRST
    ends = np.searchsorted(row[of], np.arange(len(off)))
    for i in range(len(off) - 1):
        yield f[ends[i] : ends[i + 1]]


def fit_bags(rows: list[tuple[int, np.ndarray]], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-5) -> Bags:
    """Fits on ``rows``, (label, features as ``_compact`` gives them). Works in slices of ``SLICE`` features, so the
    driver holds eight bytes a feature beside its input."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Bags(np.zeros(DIMS, np.float32), -6.0)
    n, held, sizes = len(y), np.zeros(DIMS, np.int64), []
    for _, marks in rows:
        held[np.unique(marks & ~FIRST)] += 1
        sizes.append(np.count_nonzero(marks & FIRST))
    seen = held >= SEEN
    used, place = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
    bag, start = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)])
    parts, sents = [], []
    for i, (_, marks) in enumerate(rows):
        f = marks & ~FIRST
        keep = seen[f]
        parts.append(place[f[keep]])
        sents.append((start[i] - 1 + np.cumsum(marks >= FIRST)).astype(np.int32)[keep])
    f, sent = np.concatenate(parts), np.concatenate(sents)
    del parts, sents
    # slices end where a sentence does
    cuts = np.unique(np.searchsorted(sent, np.append(sent[::SLICE], len(bag))))
    slices = [(a, b, sent[a], sent[b - 1] + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    weight = np.where(y > 0, np.sqrt((n - y.sum()) / y.sum()), 1.0)  # toxic documents are the rarer class
    w, b, slack, b_slack = np.zeros(len(used)), -5.0, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        z = np.full(len(bag), b)
        for i, j, lo, hi in slices:
            z[lo:hi] += np.bincount(sent[i:j] - lo, w[f[i:j]], minlength=hi - lo)
        p = sigmoid(z)
        quiet = np.minimum(np.bincount(bag, -np.logaddexp(0, z), minlength=n), -1e-9)
        pull = np.where(y > 0, np.exp(quiet) / -np.expm1(quiet), -1.0)
        up = p * (pull * weight)[bag] / n
        g = ridge * w
        for i, j, _, _ in slices:
            g -= np.bincount(f[i:j], up[sent[i:j]], minlength=len(used))
        gb = -up.sum()
        slack += g * g
        b_slack += gb * gb
        w -= rate * g / np.sqrt(slack + 1e-12)
        b -= rate * gb / np.sqrt(b_slack + 1e-12)
    weights = np.zeros(DIMS, np.float32)
    weights[used] = w
    return Bags(weights, float(b))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: CRC-32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> Bags:
    known = labels.where(~held_out(id_col)).where("toxic is not null")
    return fit_bags(gather(labelled_sample(docs, known, F.col("toxic"), most, id_col, text_col), _compact, "<u4"))


def _score(model: Bags):
    def run(batches):
        for batch in batches:
            for a, b, buf, off in X.blocks(batch.column(1)):
                start, end, row, of, f = sentences(buf, off)
                z = model.bias + np.bincount(of, model.weights[f], minlength=len(row))
                score = -np.expm1(np.bincount(row, -np.logaddexp(0, z), minlength=b - a))
                bad = np.bincount(row, z >= 0, minlength=b - a).astype(np.int64)
                order = np.lexsort((-start, z, row))
                last = np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True)) if len(row) else np.zeros(0, np.int64)
                top = order[last]
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                carry = z >= 0
                carry[top] = True
                at = np.flatnonzero(carry)
                found = pa.StructArray.from_arrays([pa.array(chars[start[at]] - chars[off[row[at]]]), pa.array(chars[end[at]] - chars[off[row[at]]]), pa.array(sigmoid(z[at]))], ["start", "end", "score"])
                located = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(b - a + 1)).astype(np.int32)), found)
                s, e, p = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros(b - a)
                s[row[top]], e[row[top]], p[row[top]] = chars[start[top]] - chars[off[row[top]]], chars[end[top]] - chars[off[row[top]]], sigmoid(z[top])
                none = np.bincount(row, minlength=b - a) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.clip(score, 0, 1) + 0.0), pa.array(bad), pa.array(s, mask=none), pa.array(e, mask=none), pa.array(p, mask=none), located], ["id", "score", "n_offending", "worst_start", "worst_end", "worst_score", "sentences"])

    return run


def score(docs: DataFrame, model: Bags, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_offending (sentences at 0.5 or more), the worst sentence's span in code points with its own score, and
    ``sentences``: (start, end, score) of each sentence at 0.5 or more and of the worst in any case, in the text's order."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lean(_score(model)), f"id {docs.schema[id_col].dataType.simpleString()}, score double, n_offending long, worst_start long, worst_end long, worst_score double, sentences array<struct<start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)
