"""Hashed byte n-grams of lower-case words, and bounded samples of labelled rows; shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII that isn't a letter separates words; bytes above ASCII count as letters here.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_FACTOR = (np.uint32(1), np.uint32(0x9E3779B1))


def clean(text: str | None) -> bytes:
    """Lower-case words with one space around each, as UTF-8; empty without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def codes(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for every n-gram of that order in data (uint8)."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    x = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        x = (x ^ data[k : k + n]) * _FACTOR[1]
        x ^= x >> np.uint32(15)
    return (x >> np.uint32(32 - bits)).astype(np.int64)


def features(text: str | None, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all n-grams of the whole text."""
    data = np.frombuffer(clean(text), dtype=np.uint8)
    return np.concatenate([codes(data, n, bits) for n in orders]) if len(data) else np.zeros(0, dtype=np.int64)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts joined to arrays of about limit bytes: the first text's index, the bytes, each text's start."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])]).astype(np.int64)
        yield at, np.frombuffer(b"".join(texts[at:end]), dtype=np.uint8), starts
        at = end


def sample(rows: DataFrame, label: str, most: int, seed: int) -> tuple[DataFrame, dict]:
    """About most rows of each label value, chosen by a hash of doc_id, and the rows there are of each.

    Needs no shuffle of the rows: label values are counted and each gets the
    rate that leaves most rows; rows without a label are left out.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.where("false"), counts
    rate = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(F.col(label).isNotNull()).where(draw < F.element_at(rate, F.col(label))), counts
