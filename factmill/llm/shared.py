"""Windows that also start in an earlier document: what both substring deduplicators build on.

A window is W consecutive tokens (bytes or words) of one document. Writing a
row for every window would multiply the corpus, so windows are grouped: each
belongs to the q-gram inside it with the smallest hash, its anchor. Equal
windows have equal anchors wherever they stand. Consecutive windows with one
anchor form a run, and one row stands for a run.

1. Rows meet by anchor. An anchor seen in one document alone is settled.
2. A run equal as a whole to a run of an earlier document is covered as a
   whole. What is left are the first documents of every distinct run.
3. Of these, two runs can share a window only if they agree on the anchor with
   half of the other tokens to its left, or to its right; the rest is settled.
4. Windows of the remaining runs meet one by one, by hash.

Everything is judged on the input; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, mix, rolling, signed, slices, tidy

#: Tokens handled at once in a task; longer documents are handled piece by piece.
PIECE_TOKENS = 1 << 20
_ODD = pow(0x9E3779B97F4A7C15, -1, 1 << 64)

Tokens = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Scheme:
    """tokens: texts to (a 64-bit value for each token of all texts, tokens in each text); window and anchor sizes.

    turns: anchors, and then windows, are gathered in so many slices of their
    hash, one after the other, which divides the disk that their shuffle takes
    and repeats the search for anchors.
    """

    tokens: Tokens
    window: int
    anchor: int
    turns: int = 1


def _sums(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that align its parts."""
    power = np.full(len(tok) + 1, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    inverse = np.full(len(tok) + 1, np.uint64(_ODD))
    inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(len(tok) + 1, dtype=np.uint64)
    np.cumsum(tok * power[:-1], out=total[1:])
    return total, inverse


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(tok: np.ndarray, doc: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, ...]:
    """Anchor, context, first window and number of windows of every run.

    doc: for each token a number that tells its text. The context has 12 bits
    each for the half contexts left and right of the anchor (0: no window of the
    run reaches so far) and 40 for the run as a whole.
    """
    w, q = scheme.window, scheme.anchor
    if len(tok) < w:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    grams = rolling(tok, q)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_minimum(key, w - q + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = doc[: len(anchor)] == doc[w - 1 :]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1]) | ~valid[:-1]
    starts = np.flatnonzero(new & valid)
    if not len(starts):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    bounds = np.flatnonzero(new | ~valid)
    ends = np.append(bounds, len(anchor))[np.searchsorted(bounds, starts, "right")]
    at, n = anchor[starts], ends - starts
    total, inverse = _sums(tok)
    part = lambda a, b: mix((total[b] - total[a]) * inverse[a])
    half = (w - q) // 2
    left, right = starts <= at - half, ends - 1 + w >= at + q + half
    few = lambda h: h % np.uint64(4095) + np.uint64(1)
    l12 = np.where(left, few(part(np.maximum(at - half, 0), at + q)), np.uint64(0))
    r12 = np.where(right, few(part(at, np.minimum(at + q + half, len(tok)))), np.uint64(0))
    whole = mix(part(starts, ends - 1 + w) ^ mix(((at - starts) * 65536 + n).astype(np.uint64)))
    return grams[at], (l12 << np.uint64(52)) | (r12 << np.uint64(40)) | (whole >> np.uint64(24)), starts, n


def _pieces(texts: list[bytes], scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, text number of each, position of each in its text), long inputs cut so that no window is lost."""
    tok, counts = scheme.tokens(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    position = np.arange(len(tok)) - np.repeat(np.cumsum(counts) - counts, counts)
    for a in range(0, max(len(tok), 1), PIECE_TOKENS):
        b = a + PIECE_TOKENS + scheme.window - 1
        yield tok[a:b], text[a:b], position[a:b]


def tag(text: bytes) -> int:
    """16 bits that tell apart different texts under one doc_id."""
    import zlib

    return zlib.crc32(text) & 0xFFFF


#: place = first window * 2**24 + windows * 2**16 + tag
RUN = "anchor long, context long, doc_id long, place long"


def run_rows(docs: DataFrame, scheme: Scheme, turn: int = 0) -> DataFrame:
    """Runs whose anchors are in one slice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PIECE_TOKENS):
            texts = batch.column("text").to_pylist()
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = np.array([tag(t) for t in texts], dtype=np.int64)
            for tok, text, position in _pieces(texts, scheme):
                anchor, context, start, n = runs(tok, text, scheme)
                if scheme.turns > 1:
                    mine = (anchor >> np.uint64(8)) % np.uint64(scheme.turns) == turn
                    anchor, context, start, n = anchor[mine], context[mine], start[mine], n[mine]
                if len(start):
                    of = text[start]
                    place = (position[start] << 24) + (n << 16) + tags[of]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(context)), pa.array(ids[of]), pa.array(place)], names=["anchor", "context", "doc_id", "place"])

    return docs.mapInArrow(rows, RUN)


def shared_spans(docs: DataFrame, scheme: Scheme, name: str) -> DataFrame:
    """(doc_id, tag, spans): what documents(doc_id, text as binary) share with earlier ones.

    spans are (start, length) structs in tokens of the text; they may overlap.
    Documents with a null doc_id take no part: they are neither earlier nor later.
    """
    spark = docs.sparkSession
    w = scheme.window
    docs = docs.where("doc_id IS NOT NULL")
    by = Window.partitionBy("anchor")
    found = []
    for turn in range(scheme.turns):
        met = run_rows(docs, scheme, turn).withColumn("lo", F.min("doc_id").over(by)).withColumn("hi", F.max("doc_id").over(by)).where("lo < hi").drop("lo", "hi")
        first = F.min("doc_id").over(Window.partitionBy("anchor", "context"))
        met = materialize(met.withColumn("covered", first < F.col("doc_id")), f"{name}-met")
        tidy(spark)
        left, right = F.expr("shiftrightunsigned(context, 52)"), F.expr("shiftrightunsigned(context, 40) & 4095")
        firsts = met.where("NOT covered").select("anchor", "doc_id", "place", left.alias("l"), right.alias("r"))
        spread = lambda c: F.when(F.col(c) > 0, F.max("doc_id").over(Window.partitionBy("anchor", c)) > F.min("doc_id").over(Window.partitionBy("anchor", c)))
        open_runs = firsts.withColumn("sl", spread("l")).withColumn("sr", spread("r")).where("sl OR sr").select("doc_id", "place", F.lit(False).alias("covered"))
        found.append(materialize(met.where("covered").select("doc_id", "place", "covered").unionByName(open_runs), f"{name}-runs"))
        discard(met)
        tidy(spark)
    runs_ = reduce(DataFrame.unionByName, found)
    covered = runs_.where("covered").select("doc_id", (F.col("place") % 65536).cast("int").alias("tag"), F.expr("place DIV 16777216").alias("start"), (F.expr("place DIV 65536") % 256 + (w - 1)).alias("length"))
    open_runs = runs_.where("NOT covered").select("doc_id", "place")
    open_runs = open_runs.groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=PIECE_TOKENS):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy()
            places = batch.column("places")
            tags = [tag(t) for t in texts]
            marked = []
            for i, p in enumerate(places):
                p = np.asarray(p.values.to_numpy())
                p = p[(p & 0xFFFF) == tags[i]]
                start, n = p >> 24, (p >> 16) & 255
                marked.append(np.unique(np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)))
            for tok, text, position in _pieces(texts, scheme):
                if len(tok) < w:
                    continue
                want = np.zeros(len(tok), dtype=bool)
                edge = np.flatnonzero(np.diff(text, prepend=-1))
                for i, a in zip(text[edge], edge, strict=True):
                    at = marked[i] - position[a] + a
                    at = at[(at >= a) & (at < len(tok))]
                    want[at] = True
                at = np.flatnonzero(want[: len(tok) - w + 1])
                at = at[text[at] == text[at + w - 1]]
                if len(at):
                    total, inverse = _sums(tok)
                    h = mix((total[at + w] - total[at]) * inverse[at])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ids[text[at]]), pa.array((position[at] << 16) + np.array(tags)[text[at]])], names=["h", "doc_id", "place"])

    checked = docs.join(open_runs, "doc_id").select("doc_id", "text", "places").mapInArrow(windows, "h long, doc_id long, place long")
    checked = materialize(checked.withColumn("turn", F.pmod("h", F.lit(scheme.turns)).cast("int")), f"{name}-windows", "turn")
    tidy(spark)
    singles = []
    for turn in range(scheme.turns):
        some = checked.where(F.col("turn") == turn).drop("turn")
        earliest = some.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo")
        singles.append(materialize(some.join(earliest, "h").where("lo < doc_id").select("doc_id", "place"), f"{name}-later"))
        tidy(spark)
    discard(checked)
    single = reduce(DataFrame.unionByName, singles).select("doc_id", (F.col("place") % 65536).cast("int").alias("tag"), F.expr("place DIV 65536").alias("start"), F.lit(w).cast("long").alias("length"))
    spans = covered.unionByName(single).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = materialize(spans, f"{name}-spans")
    discard(*found, *singles)
    tidy(spark)
    return spans


def removed(spans, n: int) -> np.ndarray:
    """Which of a text's n tokens the spans (an Arrow struct array, or None) cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if spans is not None and len(spans):
        start, length = (spans.field(f).to_numpy() for f in ("start", "length"))
        np.add.at(edge, start, 1)
        np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0
