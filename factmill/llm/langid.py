"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over
hashed byte n-grams says on which side a text is. Classifiers are log ratios of
smoothed n-gram frequencies of the two sides, averaged over the text and
calibrated by a logistic fit on rows that were not counted. Decoding sums each
bit's logistic loss against a codeword, weighted by how far the bit beats
chance, and takes the nearest codeword; where the second is nearly as near the
text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_rows, held_out, slices
from .ngrams import chunks, clean, codes, sample

ORDERS, BITS = (2, 3), 16
#: Labelled rows to learn from, at most about so many for each language.
MOST_ROWS = 3000
#: Two codewords whose losses differ by less are ambiguous.
MARGIN = 0.5
SEED = 5
UNDETERMINED = "und"


def code_matrix(k: int, seed: int = SEED) -> np.ndarray:
    """Codewords of k classes as rows of -1 and 1: all splits for few classes, else the best of random ones."""
    if k < 2:
        return np.ones((k, 0))
    if k <= 7:
        bits = np.arange(1, 2 ** (k - 1))
        return np.array([[1] * len(bits), *([1 - 2 * ((b >> i) & 1) for b in bits] for i in range(k - 1))], dtype=float)
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    drawn = [rng.choice([-1.0, 1.0], (k, n)) for _ in range(50)]
    near = lambda c: (n - c @ c.T + 2 * n * np.eye(k)).min()
    return max((c for c in drawn if (abs(c.sum(0)) < k).all()), key=near, default=drawn[0])


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x buckets
    scale: np.ndarray  # bits
    shift: np.ndarray
    trust: np.ndarray


def margins(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Mean weight of each cleaned text's n-grams: texts x code bits."""
    out = np.zeros((len(texts), len(weights)))
    n = np.zeros(len(texts))
    for at, data, starts in chunks(texts):
        size = np.diff(starts)
        for order in ORDERS:
            has = np.flatnonzero(size >= order)
            if not len(has):
                continue
            buckets = codes(data, order, bits)
            first, end = starts[has], starts[has + 1] - order + 1
            n[at + has] += end - first
            for b, w in enumerate(weights):
                total = np.concatenate([[0.0], np.cumsum(w[buckets], dtype=np.float64)])
                out[at + has, b] += total[end] - total[first]
    return out / np.maximum(n, 1)[:, None]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of y (0, 1) on x by Newton steps: scale, shift, and how far it beats chance."""
    a, b, spread = 0.0, 0.0, max(float(np.std(x)), 1e-9)
    z = x / spread
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    right = float(np.mean((a * z + b > 0) == (y > 0.5))) if len(y) else 0.5
    return a / spread, b, max(2 * right - 1, 0.05)


def train(docs: DataFrame, most: int = MOST_ROWS, seed: int = SEED) -> Model:
    """Learn from documents(doc_id, text, lang) outside the held-out fold; rows without lang are left out."""
    rows = doc_rows(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    chosen, _ = sample(rows, "lang", most, seed)
    chosen = chosen.withColumn("counted", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(4)) > 0).repartition(8, "doc_id")
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            texts = [clean(t) for t in batch.column("text").to_pylist()]
            for lang, text in zip(langs, texts, strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                got = sums.setdefault(lang, np.zeros(size))
                for order in ORDERS:
                    got += np.bincount(codes(data, order, BITS), minlength=size)
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(got[at])], names=["lang", "bucket", "n"])

    sums: dict[str, np.ndarray] = {}
    counted = chosen.where("counted").select("lang", "text").mapInArrow(count, "lang string, bucket long, n double")
    for lang, bucket, n in counted.groupBy("lang", "bucket").agg(F.sum("n")).collect():  # languages x buckets at most
        sums.setdefault(lang, np.zeros(size))[bucket] = n
    langs = sorted(sums)
    code = code_matrix(len(langs), seed)
    share = np.array([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * size) for x in langs]) if langs else np.zeros((0, size))
    weights = np.array([np.log(share[c > 0].mean(0)) - np.log(share[c < 0].mean(0)) for c in code.T], dtype=np.float32).reshape(code.shape[1], size)
    model = Model(langs, code, weights, np.ones(len(weights)), np.zeros(len(weights)), np.ones(len(weights)))
    if not len(weights):
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = margins([clean(t) for t in batch.column("text").to_pylist()], weights)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(list(m), pa.list_(pa.float64()))], names=["lang", "m"])

    rest = chosen.where("NOT counted").select("lang", "text").mapInArrow(measure, "lang string, m array<double>").collect()
    rest = [r for r in rest if r[0] in sums]
    if rest:
        x, y = np.array([r[1] for r in rest]), np.array([code[langs.index(r[0])] for r in rest])
        fits = [_fit(x[:, b], (y[:, b] + 1) / 2) for b in range(x.shape[1])]
        model.scale, model.shift, model.trust = (np.array(c) for c in zip(*fits, strict=True))
    return model


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share among all by loss, and whether it is ambiguous."""
    logit = m * model.scale + model.shift
    loss = (np.logaddexp(0, -logit[:, None, :] * model.code[None]) * model.trust).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    two = np.sort(loss, axis=1)[:, :2]
    return loss.argmin(1), share.max(1), (two[:, 1] - two[:, 0] < MARGIN) if loss.shape[1] > 1 else np.zeros(len(m), dtype=bool)


def annotate(docs: DataFrame, model: Model, columns: tuple[str, str, str] = ("__lang_pred", "__score", "__ambiguous")) -> DataFrame:
    """docs with the language, score and ambiguity of every whole text (column text), in columns of these names, which docs mustn't have.

    A text that is null or has no letter is und with score 0 and not ambiguous;
    so is every text if nothing was learned. All other columns come back as they are.
    """
    learned = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField(c, kind) for c, kind in zip(columns, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learned.value
        for batch in slices(batches):
            texts = [clean(t) for t in batch.column("text").to_pylist()]
            known = np.array([bool(t) for t in texts]) & bool(model.langs)
            if model.langs:
                best, score, ambiguous = decode(margins(texts, model.weights), model)
            else:
                best, score, ambiguous = np.zeros(len(texts), dtype=int), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            names = [model.langs[i] if k else UNDETERMINED for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(ambiguous & known)], names=[*batch.schema.names, *added.names]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of documents(doc_id, text).

    A null doc_id counts as not held out.
    """
    told = annotate(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return told.select("doc_id", "held_out", *(F.col(f"__{c}").alias(c) for c in ("lang_pred", "score", "ambiguous")))
