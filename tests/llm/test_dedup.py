"""Deduplicators against brute force."""

import hashlib

import pytest

from factmill.llm import lines, neardup, substrings


def shared(texts, window, tokens):
    """For each document, which tokens are covered by a window that also starts in one with a smaller id."""
    first = {}
    for i in sorted(texts):
        t = tokens(texts[i])
        for k in range(len(t) - window + 1):
            first.setdefault(tuple(t[k : k + window]), i)
    out = {}
    for i in texts:
        t = tokens(texts[i])
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if first[tuple(t[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = gone
    return out


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_bytes(docs, corpus, texts_by_id):
    want = shared(texts_by_id, 50, lambda t: t.encode())
    got = substrings.cut_bytes(docs, substrings.byte_spans(docs)).collect()
    assert len(got) == len(corpus)
    assert sum(r.n_removed for r in got) > 0
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        t, gone = texts_by_id[r.doc_id].encode(), want[r.doc_id]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (len(t), sum(gone), spans, kept, sha(kept))


def test_words(docs, corpus, texts_by_id):
    want = shared(texts_by_id, 13, lambda t: t.encode().split())
    got = substrings.cut_words(docs, substrings.word_spans(docs)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            w, gone = texts_by_id[r.doc_id].encode().split(), want[r.doc_id]
            kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), sha(kept))


def test_texts_of_one_id_are_told_apart(spark):
    long = "the quick brown fox jumps over the lazy dog and then some more words to fill a window of fifty bytes"
    rows = spark.createDataFrame([(1, long), (2, long), (2, "short")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.cut_bytes(rows, substrings.byte_spans(rows)).collect()}
    assert got == {(1, len(long)): 0, (2, len(long)): len(long), (2, 5): 0}


def components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def shingles(text, n):
    w = [x.lower() if x.isascii() else x for x in text.split()]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard(docs, corpus, texts_by_id, words, percent):
    sets = {i: shingles(t, words) for i, t in texts_by_id.items()}
    want = components(sets, percent)
    got = neardup.link(docs, neardup.Similarity(words=words, percent=percent)).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])


def test_jaccard_group_of_near_copies(spark):
    """A chain of texts, each near its neighbours only, and a crowd around one text."""
    base = [f"w{i}" for i in range(60)]
    chain = [base[k : k + 50] for k in range(0, 10, 2)]
    crowd = [[*(f"v{i}" for i in range(100)), f"tail{n}"] for n in range(80)]
    rows = [(i, " ".join(w)) for i, w in enumerate(chain + crowd)]
    sets = {i: shingles(t, 4) for i, t in rows}
    got = {r.doc_id: r.component_id for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Similarity(words=4, percent=85)).collect()}
    assert got == components(sets, 85)


def test_pigeonhole_holds():
    """Linked sets always share a key."""
    import numpy as np

    rng, sim = np.random.default_rng(0), neardup.Similarity(words=4, percent=85)
    for n in (6, 7, 12, 30, 75, 200, 900):
        for _ in range(30):
            common = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            apart = sim.most_apart(n)
            a = np.concatenate([common, rng.integers(0, 1 << 62, int(rng.integers(0, apart // 2 + 1)), dtype=np.uint64)])
            b = np.concatenate([common, rng.integers(0, 1 << 62, int(rng.integers(0, apart // 2 + 1)), dtype=np.uint64)])
            if 100 * n < 85 * (len(a) + len(b) - n):
                continue

            def bands(s):
                top = int(np.searchsorted(sim.edges, len(s), "right")) - 1
                low = int(np.searchsorted(sim.edges, -(-len(s) * 85 // 100), "right")) - 1
                return {k for band in range(low, top + 1) for k in neardup.part_keys(np.sort(s), band, sim).tolist()}

            assert bands(a) & bands(b)


def line_brute(texts):
    words = {(i, k): line.split() for i, t in texts.items() for k, line in enumerate(t.split("\n")) if line.split()}

    def near(a, b):
        if len(a) < 5 or len(b) < 5 or a == b:
            return a == b
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    keys = sorted(words)
    first = {}
    for k in keys:
        first.setdefault(tuple(words[k]), k)
    gone = {k for k in keys if first[tuple(words[k])] != k}
    heads = sorted(first.values())
    gone |= {b for n, b in enumerate(heads) if any(near(words[a], words[b]) for a in heads[:n])}
    return words, gone


def test_lines(docs, corpus, texts_by_id):
    words, gone = line_brute(texts_by_id)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(corpus) and {k for k in gone}
    for r in got:
        if r.doc_id is None:
            continue
        ls = texts_by_id[r.doc_id].split("\n")
        kept = "\n".join(x for k, x in enumerate(ls) if (r.doc_id, k) not in gone)
        assert ((r.text or ""), r.n_lines, r.n_removed) == (kept, sum((r.doc_id, k) in words for k in range(len(ls))), sum((r.doc_id, k) in gone for k in range(len(ls))))


def test_empty_tables(empty):
    assert substrings.cut_bytes(empty, substrings.byte_spans(empty)).count() == 0
    assert substrings.cut_words(empty, substrings.word_spans(empty)).count() == 0
    assert neardup.link(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0


def test_lines_with_clashing_columns(spark):
    """Columns with the names of counts, and with those that the operator uses itself."""
    rows = [(1, "a b c d e\nx", 7, 8, "s", "g"), (2, "a b c d f\ny\n", 9, 9, "t", "h"), (3, None, 1, 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, n_lines long, __split string, __gone string")
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert [got[i].text for i in (1, 2, 3)] == ["a b c d e\nx", "y\n", None]
    assert [(got[i].n_lines, got[i].n_removed, got[i].n_near) for i in (1, 2, 3)] == [(2, 0, 0), (2, 1, 1), (0, 0, 0)]
    assert [(got[i]["__split"], got[i]["__gone"]) for i in (1, 2, 3)] == [("s", "g"), ("t", "h"), (None, None)]


def test_lines_least_words(spark):
    docs = spark.createDataFrame([(1, "a b c\nd"), (2, "a b x\nd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}[2] == "a b x"
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs, min_words=3).collect()}[2] == ""
