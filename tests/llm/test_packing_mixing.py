import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factmill.llm import mixing, packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé\n\t.,'12 <|endoftext|>漢", max_size=30), max_size=6))
def test_ids_are_the_tokenizers(texts):
    exact = packing._encoders(packing.TOKENIZER)[0]
    assert packing.encode_texts(texts) == [np.asarray(exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def fewest(lengths: tuple[int, ...], capacity: int) -> int:
    """The least sequences that hold all lengths, by trying every place for each, the longest first."""
    best = len(lengths)

    def place(i: int, gaps: tuple[int, ...]) -> None:
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for gap in sorted({g for g in gaps if g >= lengths[i]}):
            at = gaps.index(gap)
            place(i + 1, (*gaps[:at], gap - lengths[i], *gaps[at + 1 :]))
        place(i + 1, (*gaps, capacity - lengths[i]))

    place(0, ())
    return best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=4))
@example({7: 2, 6: 2, 5: 3})
def test_plan_is_near_the_fewest_sequences(counts):
    lengths = tuple(sorted((k for k, n in counts.items() for _ in range(n)), reverse=True))
    used = {first + k for length, rank, n, first, offset in packing.plan(counts, 20) for k in range(n)}
    # Best fit of falling lengths needs at most 11/9 of the fewest, and 6/9 (Dosa).
    assert 9 * len(used) <= 11 * fewest(lengths, 20) + 6


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@example({21: 1, 22: 6, 44: 5})
def test_plan_places_everything_without_overlap(counts):
    placed, used = defaultdict(int), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, 64):
        placed[length] += n
        for k in range(n):
            used[first + k].append((offset, length))
    assert dict(placed) == counts
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    # No sequence could take the least piece of a later one: of two sequences, no more than one is half empty.
    assert sum(2 * sum(length for _, length in parts) <= 64 for parts in used.values()) <= 1


def test_pack(docs, corpus):
    got = packing.pack_documents(docs, capacity=256).collect()
    exact = packing._encoders(packing.TOKENIZER)[0]
    want = []
    for doc, text, *_ in corpus:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert len(by) <= 1.05 * sum(r.length for r in got) / 256 + 2


def targets(sizes, weights=(1, 2, 3), most=3):
    """The sharing out, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
        left -= sum(out[s] for s in over)
    return out


def test_mix(docs, corpus):
    got = mixing.mix(docs, block=8).collect()
    sizes = defaultdict(int)
    for _, text, _, source, *_ in corpus:
        sizes[source] += len((text or "").encode().split())
    want = targets(sizes)
    assert len(got) == len(corpus)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 8000  # less than the longest document
    again = mixing.mix(docs.repartition(7), block=8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefg"), st.integers(0, 50), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(targets(sizes))


def test_rounding_is_fair(spark):
    """Over many seeds a document is taken as often as its share says."""
    rows = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    runs = [{r.doc_id: r.copies for r in mixing.mix(rows, seed=s).collect()} for s in range(12)]
    share = {r.doc_id: r.target / r.source_size for r in mixing.mix(rows).collect()}
    mean = np.mean([[run[i] - share[i] for i in share] for run in runs])
    assert abs(mean) < 0.1


def test_apply_mix(docs):
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0
