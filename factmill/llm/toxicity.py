"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is the set of its hashed n-grams. A feature's value is the log ratio
of its smoothed frequency among toxic and other texts, so n-grams that say
nothing are near 0; a logistic regression is fitted on these. The sample is
balanced; the shift is corrected to the share of toxic rows among all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, held_out, slices
from .ngrams import features, sample

ORDERS, BITS = (3, 4, 5), 18
#: Labelled rows to learn from, at most about so many of each class.
MOST_ROWS = 2000
L2, STEPS = 1.0, 60
SEED = 11


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times coefficient, by bucket
    shift: float


def fit(sets: list[np.ndarray], labels: np.ndarray, prior: float, size: int = 1 << BITS) -> Model:
    """Log-count ratios, then L2 logistic regression by accelerated gradient steps."""
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():  # one class or none: the share is all there is to say
        return Model(np.zeros(size, dtype=np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    # Parts of the rows, so that no temporary array is as long as all features together.
    parts = [(np.concatenate(sets[a : a + 200]), np.array([len(s) for s in sets[a : a + 200]]), slice(a, a + 200)) for a in range(0, len(sets), 200)]
    sets.clear()

    def spread(by_row: np.ndarray) -> np.ndarray:
        """Sum of by_row over the rows that have each feature."""
        return sum(np.bincount(flat, weights=np.repeat(by_row[rows], n), minlength=size) for flat, n, rows in parts)

    p = spread(y) + 1.0
    q = spread(1 - y) + 1.0
    ratio = np.log(p / (y.sum() + 2)) - np.log(q / ((1 - y).sum() + 2))

    def dot(w: np.ndarray) -> np.ndarray:
        out = []
        for flat, n, _ in parts:
            total = np.concatenate([[0.0], np.cumsum((ratio * w)[flat])])
            out.append(np.diff(total[np.concatenate([[0], np.cumsum(n)])]))
        return np.concatenate(out)

    # Lipschitz constant of the loss by power iteration.
    v = np.random.default_rng(SEED).normal(size=size)
    for _ in range(8):
        v = ratio * spread(dot(v / np.linalg.norm(v)))
    step = 1 / (np.linalg.norm(v) / 4 + L2 + len(y) / 4)
    w, b, last_w, last_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for k in range(STEPS):
        m = k / (k + 3)
        at_w, at_b = w + m * (w - last_w), b + m * (b - last_b)
        miss = 1 / (1 + np.exp(-np.clip(dot(at_w) + at_b, -30, 30))) - y
        last_w, last_b = w, b
        w = at_w - step * (ratio * spread(miss) + L2 * at_w)
        b = at_b - step * miss.sum()
    drawn = y.mean()
    b += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return Model((ratio * w).astype(np.float32), float(b))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, seed: int = SEED) -> Model:
    """Learn from labels(doc_id, toxic) outside the held-out fold; rows with a null label are left out.

    If a doc_id is labelled twice, the higher label counts.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen, counts = sample(known, "toxic", most, seed)
    rows = doc_rows(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # most rows of each class, so bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(features(t, ORDERS, BITS)).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "toxic", "buckets"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, buckets binary").toArrow().sort_by([("doc_id", "ascending"), ("buckets", "ascending")])
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total, 1e-4), 1 - 1e-4) if total else 1e-4
    return fit([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in got.column("buckets")], got.column("toxic").to_numpy(), prior)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text of documents(doc_id, text); a null or empty text gets the score of no n-grams."""
    learned = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learned.value
        seen = np.zeros(len(model.weights), dtype=np.float32)
        for batch in slices(batches):
            logit = np.full(batch.num_rows, model.shift)
            for i, text in enumerate(batch.column("text").to_pylist()):
                buckets = features(text, ORDERS, BITS)
                if len(buckets):
                    seen[buckets] = 1
                    logit[i] += seen @ model.weights
                    seen[buckets] = 0
            value = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, SCHEMA)
