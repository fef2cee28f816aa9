"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best-fit. Documents are range-sorted by length and get a rank
within their length; gaps (open sequences) are kept sorted by the room left.
In each round a successor sweep runs from the longest waiting length down and
gives every document the smallest gap that holds it, one document per gap;
documents that compete for the same gaps are served in rank order and the
rest go on to the next larger gap. Then the gaps are updated and the next round
begins; documents without any gap open new sequences.

Lengths are integers up to the capacity, and documents of one length are
interchangeable. So a round never has to touch rows: it works on runs of equal
lengths and runs of equal gaps, whose number depends on the capacity and not
on the corpus. The rows take part twice, both times distributed: in the range
sort that ranks them, and at the end, when each row finds the run that holds
its rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, materialize, partitions, slices

TOKENIZER = "byte_bpe_50k"
#: Ends every document.
END_ID = 0
CAPACITY = 2048

# ---------------------------------------------------------------- tokens


@cache
def _encoders(name: str):
    """The tokenizer itself, and the same vocabulary in a faster library."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    return exact, fast, size, [t.content for t in exact.get_added_tokens_decoder().values()]


def _le(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def encode_texts(texts: list[str], name: str = TOKENIZER) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    The vocabulary's pattern never joins a non-space with the space behind it,
    so a text without two spaces in a row may be cut before each space. The
    distinct cuts of the batch are encoded in one call and put together again.
    Texts with double spaces are encoded whole; texts that hold a special
    token's string go to the tokenizer itself, whose rules then apply.
    """
    exact, fast, size, special = _encoders(name)
    out: list[bytes] = [b""] * len(texts)
    plain = []
    for i, t in enumerate(texts):
        if any(s in t for s in special):
            out[i] = _le(exact.encode(t, add_special_tokens=False).ids)
        elif "  " in t:
            out[i] = _le(fast.encode_ordinary(t))
        elif t:
            plain.append(i)
    if not plain:
        return out
    parts = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
    starts = parts.offsets.to_numpy()
    coded = parts.flatten().dictionary_encode()
    words, index = coded.dictionary, coded.indices.to_numpy()
    width = pc.binary_length(words).to_numpy(zero_copy_only=False)
    joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))[0].as_py()
    flat = np.asarray(fast.encode_ordinary(joined), dtype="<u4")
    token_end, word_end = np.cumsum(size[flat]), np.cumsum(width + 1)
    if width.all():
        data, offsets = flat.tobytes(), np.concatenate([[0], 4 * (np.searchsorted(token_end, word_end) + 1)])
    else:  # a space that ends a text would meet the next cut's space, so each is encoded by itself
        pieces = [_le(fast.encode_ordinary(f" {w}")) for w in words.to_pylist()]
        data, offsets = b"".join(pieces), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)])
    taken = table.take(pa.array(index))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)
    body = memoryview(taken.buffers()[2] or b"")
    for k, i in enumerate(plain):
        a, b = int(starts[k]), int(starts[k + 1])
        out[i] = _le(fast.encode_ordinary(texts[i].partition(" ")[0])) + bytes(body[at[a + 1] : at[b]])
    return out


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: its ids and one END_ID, cut only where they exceed capacity.

    The remainder comes first, so all other pieces are full. A null text counts
    as empty and gives one piece with END_ID alone; a null doc_id stays null;
    repeated rows give repeated pieces. keep_ids adds the ids (array of int).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=16 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text").to_pylist(), name), strict=True):
                ids += _le([END_ID])
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return doc_rows(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, PIECE + ", ids array<int>" * keep_ids)


# ---------------------------------------------------------------- rounds


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place every rank of every length.

    counts: documents of each length. A run puts documents of consecutive ranks
    into sequences of consecutive numbers at the same offset.
    """
    waiting = {n: [0, c] for n, c in counts.items() if c}  # length: first rank that waits, documents that wait
    gaps: list[tuple[int, int, int]] = []  # room left, first sequence, number of sequences
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, most: int, room: int, first: int) -> int:
        rank, left = waiting[length]
        n = min(left, most)
        runs.append((length, rank, n, first, capacity - room))
        waiting[length] = [rank + n, left - n]
        if left == n:
            del waiting[length]
        if room > length:
            opened.append((room - length, first, n))
        return n

    while waiting:
        opened: list[tuple[int, int, int]] = []
        gaps.sort(reverse=True)
        stack: list[tuple[int, int, int]] = []  # gaps that hold the length at hand, the smallest on top
        at = 0
        placed = False
        for length in sorted(waiting, reverse=True):
            while at < len(gaps) and gaps[at][0] >= length:
                stack.append(gaps[at])
                at += 1
            while stack and length in waiting:
                room, first, n = stack.pop()
                used = place(length, n, room, first)
                placed = True
                if used < n:
                    stack.append((room, first + used, n - used))
        if not placed:  # what waits opens as many sequences as its tokens fill at least, the longest first
            need = -(-sum(n * c for n, (_, c) in waiting.items()) // capacity)
            for length in sorted(waiting, reverse=True):
                if need <= 0 and 2 * length <= capacity:
                    break
                n = place(length, waiting[length][1] if 2 * length > capacity else need, capacity, sequences)
                sequences, need = sequences + n, need - n
            gaps += opened
        else:
            gaps = _joined(stack + gaps[at:] + opened)
    return runs


def _joined(gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of equal room whose sequences follow each other become one."""
    out: list[tuple[int, int, int]] = []
    for room, first, n in sorted(gaps):
        if out and out[-1][0] == room and out[-1][1] + out[-1][2] == first:
            out[-1] = (room, out[-1][1], out[-1][2] + n)
        else:
            out.append((room, first, n))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, start, length, ids_crc32), whose lengths are 1 to capacity.

    Sequences are filled without gaps from offset 0. An empty table stays empty.
    """
    spark = pieces.sparkSession

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            new = np.flatnonzero(np.diff(length, prepend=last))
            start = np.zeros(len(length), dtype=np.int64)
            rank = np.arange(len(length), dtype=np.int64)
            start[new] = new
            rank -= np.maximum.accumulate(start)
            head = len(length) if not len(new) else int(new[0])
            rank[:head] += seen
            last, seen = int(length[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    kept = materialize(pieces.select(*[f.split(" ")[0] for f in PIECE.split(", ")]), "pieces")
    ordered = kept.repartitionByRange(partitions(spark), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece", "start", "ids_crc32")
    ordered = materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(ranked, PIECE + ", part int, rank long"), "ranked")
    # At most one row for each length and one more for each partition.
    before: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for length, part, n in ordered.groupBy("length", "part").count().orderBy("length", "part").toLocalIterator():
        before[length, part] = counts.get(length, 0)
        counts[length] = before[length, part] + n
    runs = sorted(plan(counts, capacity))
    lengths, ranks, _, firsts, offsets = (np.array(c, dtype=np.int64) for c in (zip(*runs, strict=True) if runs else [[]] * 5))
    base = spark.sparkContext.broadcast((before, {n: (bisect.bisect_left(lengths, n), bisect.bisect_right(lengths, n)) for n in counts}, ranks, firsts, offsets))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, span, ranks, firsts, offsets = base.value
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            key = length * (1 << 32) + part
            order = np.argsort(key, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(group):
                    n = int(length[group[0]])
                    whole = rank[group] + before[n, int(part[group[0]])]
                    a, b = span[n]
                    k = a + np.searchsorted(ranks[a:b], whole, "right") - 1
                    sequence[group], offset[group] = firsts[k] + whole - ranks[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ordered.mapInArrow(assigned, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """Tokenise, cut and pack documents(doc_id, text): one row per piece."""
    return pack(token_pieces(docs, capacity, name), capacity)
