"""Substring deduplication over bytes and over words.

Both are a minimiser window join (shared.py): a window's smallest hash is its
anchor, windows with one anchor form runs, runs are grouped by anchor, by a
hash of the whole run and by half contexts, and what is left is looked up
window by window, by hash. Windows have 50 bytes, or 13 words. This stands in for bucket-pointer
refinement (bytes) and relative Lempel-Ziv parsing (words), neither of which is
built: no buckets are refined by identifiers of later offsets, and there is no
greedy parse, no reference index and no factors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, text_bytes, word_hashes
from .shared import Scheme, removed, shared_spans, tag

#: Bytes and words of a window, and of its anchor.
BYTE_WINDOW, BYTE_ANCHOR = 50, 24
WORD_WINDOW, WORD_ANCHOR = 13, 5
_BYTE_IDS = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _BYTE_IDS[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.array([len(t) for t in texts], dtype=np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return doc_rows(docs, "doc_id", "text").withColumn("text", text_bytes())


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row with the spans of its id; which of them belong to its text the tag tells."""
    gathered = spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spans")).alias("found"))
    return rows.join(gathered, "doc_id", "left")


def _own(found, text: bytes):
    """The spans that belong to this text."""
    if found.is_valid:
        for x in found.values:
            if x["tag"].as_py() == tag(text):
                return x["spans"].values
    return None


def byte_spans(docs: DataFrame, window: int = BYTE_WINDOW, anchor: int = BYTE_ANCHOR) -> DataFrame:
    """(doc_id, tag, spans) of bytes covered by window-byte strings that also start under a smaller doc_id."""
    return shared_spans(_rows(docs), Scheme(_bytes, window, anchor, turns=2), "bytes")


def word_spans(docs: DataFrame, window: int = WORD_WINDOW, anchor: int = WORD_ANCHOR) -> DataFrame:
    """(doc_id, tag, spans) of words covered by window-word factors of documents with a smaller doc_id."""
    return shared_spans(_rows(docs), Scheme(word_hashes, window, anchor), "words")


def cut_bytes(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 of every row.

    Null texts are empty; a null doc_id keeps its whole text; equal rows and
    texts under one doc_id don't remove each other's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("found"), strict=True):
                gone = removed(_own(found, text), len(text))
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _with_spans(_rows(docs), spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (string) and kept_sha256 of every row; rules as for cut_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("found"), strict=True):
                words = text.split()
                gone = removed(_own(found, text), len(words))
                kept = b" ".join(words[i] for i in np.flatnonzero(~gone))
                out.append((doc, len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return _with_spans(_rows(docs), spans).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
