"""Byte-level BPE: encoding with a rank file, and decoding by offsets.

encode() finds pre-tokens by the automaton of pretokens.py, merges each
different one once while the cache holds it, and keeps where every id starts in
the text's bytes. decode() lays the ids' bytes out at those offsets. Both are
maps over rows: nothing is shuffled. Long texts pass in windows, each begun
where the last one's final whole token ended, so memory is bounded by a window
or the longest single pre-token.

Defined results. A null text is encoded as an empty one; it has no ids. Bytes
that aren't UTF-8 are read as U+FFFD. Repeated rows and ids, and null ids, come
back as they are; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .pretokens import boundaries

#: Code points in a window of a long text, and of many short texts together.
WINDOW = 1 << 18
#: Pre-tokens that a generation of a Python worker's cache holds (there are two), and the longest of them in bytes.
CACHED, CACHED_BYTES = 1 << 17, 64
#: Stands for a pair that doesn't merge.
NO_RANK = 1 << 60
#: From this length on pairs wait in a heap.
LONG = 64


def load(file: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and ranks."""
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(file: str) -> Encoder:
    return Encoder(load(file))


@lru_cache(2)
def _vocabulary(file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and each id's start and length."""
    ranks = load(file)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


class Encoder:
    """Merges pre-tokens by rank."""

    def __init__(self, ranks: dict[bytes, int], cached: int = CACHED) -> None:
        self.ranks, self.cached = ranks, cached
        self.known: dict[bytes, list[int]] = {}
        self.older: dict[bytes, list[int]] = {}
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def token(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        out = self.known.get(piece)
        if out is None:
            out = self.older.get(piece)
            if out is None:
                rank = self.ranks.get(piece)
                out = [rank] if rank is not None else self.merge(piece)
            if len(piece) <= CACHED_BYTES:
                if len(self.known) >= self.cached:
                    self.known, self.older = {}, self.known
                self.known[piece] = out
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The lowest-ranked adjacent pair joins, the leftmost of equal ones, until none has a rank."""
        rank = self.ranks.get
        if len(piece) >= LONG:
            return self._merge_long(piece)
        cut = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], NO_RANK) for i in cut[:-2]]
        while pairs and (best := min(pairs)) != NO_RANK:
            i = pairs.index(best)
            del cut[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[cut[i] : cut[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = rank(piece[cut[i - 1] : cut[i + 1]], NO_RANK)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with parts as a linked list and pairs in a heap; a pair that changed meanwhile is passed over."""
        n, rank = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue
            end[a], end[b], before[c] = c, -1, a
            if c < n and (r := rank(piece[a : end[c]])) is not None:
                heapq.heappush(heap, (r, a, c, end[c]))
            p = before[a]
            if p >= 0 and (r := rank(piece[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        out, a = [], 0
        while a < n:
            out.append(self.ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text: short texts share windows, a long one takes several."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < WINDOW):
                size += len(texts[end]) + 1
                end += 1
            out += self._short(texts[at:end]) if size <= WINDOW else [self._long(texts[at])]
            at = end
        return out

    def _short(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        points = _points("\0".join(texts))
        between = np.cumsum(lengths + 1)[:-1] - 1
        points[between] = 0x110000
        starts = np.flatnonzero(boundaries(points))
        size = _utf8(points)  # one byte for each separator, as in data
        at = np.append(np.cumsum(size) - size, size.sum())
        data = "\0".join(texts).encode()
        first = np.searchsorted(starts, np.append(0, between + 1))  # index of each text's first token
        cuts = at[np.append(starts, len(points))].tolist()
        out = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(starts) + 1]):
            ids: list[int] = []
            known, token = self.known.get, self.token
            for piece in map(data.__getitem__, map(slice, cuts[a : b - 1], cuts[a + 1 : b])):  # the separator is a token of its own, the last before the next text
                ids += known(piece) or token(piece)
            out.append(np.array(ids, dtype="<u4"))
        return out

    def _long(self, text: str) -> np.ndarray:
        parts, at, width = [], 0, WINDOW
        while at < len(text):
            window = text[at : at + width]
            points = _points(window)
            starts = np.flatnonzero(boundaries(points))
            if at + len(window) < len(text):
                starts = starts[starts < len(points) - 3]  # later ones may still change
                if len(starts) < 2:
                    width *= 2
                    continue
            else:
                starts = np.append(starts, len(points))
            size = _utf8(points)
            cuts = np.append(0, np.cumsum(size))[starts].tolist()
            data = window[: int(starts[-1])].encode()
            parts.append(np.array([i for a, b in zip(cuts, cuts[1:]) for i in self.token(data[a:b])], dtype="<u4"))
            at, width = at + int(starts[-1]), WINDOW
        return np.concatenate(parts)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()


def _utf8(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point; 1 for a separator."""
    return 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF) - 3 * (points == 0x110000)


def encode(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, ids, starts) of docs(doc_id, text): ids as little-endian unsigned 32-bit values, starts as 32-bit byte offsets of each (no value of Spark is longer).

    file: a rank file, at the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        for b in slices(batches):
            ids = encoder.texts([t.decode("utf-8", "replace") for t in b.column("text").to_pylist()])
            starts = [np.cumsum(n := encoder.lengths[x]) - n for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in starts], pa.binary())], ["doc_id", "ids", "starts"])

    rows = docs.select("doc_id", text_bytes().alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, starts binary")


def decode(tokens: DataFrame, file: str) -> DataFrame:
    """tokens(ids, starts) and its other columns, with decoded: the bytes of the ids, each laid at its start.

    Raises if the offsets leave gaps or overlap, as they are then another text's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, where, lengths = _vocabulary(file)
        for b in slices(batches, "ids"):
            out = []
            for ids, starts in zip(b.column("ids").to_pylist(), b.column("starts").to_pylist()):
                ids, starts = np.frombuffer(ids, dtype="<u4"), np.frombuffer(starts, dtype="<u4").astype(np.int64)
                n = lengths[ids]
                ends = starts + n
                if len(ids) and (starts[0] or not np.array_equal(starts[1:], ends[:-1])):
                    raise ValueError("offsets don't fit the ids")
                out.append(blob[np.repeat(where[ids] - starts, n) + np.arange(ends[-1] if len(ids) else 0)].tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what decode() returned."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
