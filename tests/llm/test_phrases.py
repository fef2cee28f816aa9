import random
import re
from collections import Counter

import pytest

from factmill.llm import phrases

KIND = "text string, lang string, doc_id long, rank int, phrase string, n string, block string"


def brute(rows: list[tuple], least: int, longest: int, most: int) -> list[tuple]:
    freq: dict[str, Counter] = {}
    for text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            f = freq.setdefault("und" if lang is None else lang, Counter())
            f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in freq.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in some.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                continue
            score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def corpus(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(["of", "The", "in", "new", "york", "york", "a", "É", "x.y", "z,", "end.", "\tq", "漢字"], k=rng.randint(0, 60))
        out.append((rng.choice([" ", "  ", "\n"]).join(words), rng.choice(["en", "en", "fr", None, "und"]), i, 0, "p", "n", "b"))
    odd = [(None, "en"), ("", None), ("word", "de"), ("go go " * 500, "fr"), ("go go " * 500, "fr"), ("..,,", "en"), ("one two\vthree four", "de"), ("\0 a \0 a " * 9, "en")]
    return out + [(t, lang, None, 1, None, None, None) for t, lang in odd]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_phrases_are_those_of_brute_force(spark, size):
    rows = corpus(120, size)
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = phrases.collocations(docs, least=6, longest=5, most=40, size=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 6, 5, 40)


def test_two_words_at_most_and_ties(spark):
    rows = [("a b c d", "en", 1, 0, None, None, None)] * 5
    got = phrases.collocations(spark.createDataFrame(rows, KIND), least=5, longest=2, most=2).collect()
    assert [(r.rank, r.phrase, r.score) for r in got] == [(1, "a b", 4000), (2, "b c", 4000)]


def test_without_rows_or_frequent_phrases(spark):
    assert not phrases.collocations(spark.createDataFrame([], KIND)).collect()
    assert not phrases.collocations(spark.createDataFrame(corpus(3, 1), KIND), least=10**6).collect()


def test_products_beyond_64_bits(spark):
    whole = spark.createDataFrame([("en", "a b", 2, 10**13, [10**13], [2 * 10**13], False)], "lang string, phrase string, m int, f long, lefts array<long>, rights array<long>, inner boolean")
    row = phrases.scored(whole, spark.createDataFrame([("en", 10**14)], "lang string, n long")).collect()[0]
    assert (row.a, row.l, row.r, row.score) == (10**13, 10**13, 2 * 10**13, 1000 * 10**13 * 10**14 // (2 * 10**26))


def test_a_long_text_is_split_between_words(monkeypatch):
    monkeypatch.setattr(phrases, "WINDOW", 10)
    text = b"One two-three, four " * 20 + b"x" * 50
    parts = list(phrases.slots(text))
    assert len(parts) > 20 and [w for p in parts for w in p] == text.lower().replace(b",", b" \xff ").split()


def test_steps_are_exact_and_small():
    import numpy as np
    import zstandard

    from factmill.llm.phrases import _steps, _unsteps

    for kind in (np.int32, np.int64):
        for numbers in ([], [5], [0, -1, 3, 2**30, 7], [np.iinfo(kind).min, np.iinfo(kind).max, 0]):
            values = np.array(numbers, dtype=kind)
            assert np.array_equal(_unsteps(_steps(values), kind), values)
    at = np.sort(np.random.default_rng(1).integers(0, 1 << 21, 200_000)).astype(np.int32)
    assert len(_steps(at)) < 0.7 * len(zstandard.compress(np.diff(at, prepend=np.int32(0)).tobytes(), 1))


def test_blocks_are_not_shuffled_between_levels(spark, monkeypatch):
    plans = {}

    def watched(write):
        def run(df, name, *by):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return write(df, name, *by)

        return run

    for name in ("materialize", "materialize_buckets"):
        if hasattr(phrases, name):
            monkeypatch.setattr(phrases, name, watched(getattr(phrases, name)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(120, 5)
        got = phrases.collocations(spark.createDataFrame(rows, KIND).repartition(3), least=6, longest=5, most=40, size=64)
        assert sorted(map(tuple, got.collect())) == brute(rows, 6, 5, 40)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lists = [p for name, p in plans.items() if name.startswith("phrases-lists-")]
    assert len(lists) == 4
    for plan in lists:  # only what groups say meets the blocks
        assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(block") == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("phrases_")]


def test_candidates_are_dealt_in_few_bytes(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(rng.choices(words, k=400)), "en", i, 0, None, None, None) for i in range(300)]
    text = phrases.blocks(spark.createDataFrame(rows, KIND).coalesce(1), 5, 1 << 16).persist()
    found = phrases.frequent_words(text, 1, 4).persist()
    ids = [i for r in found.where("block IS NULL").collect() for i in r.id]
    assert len(set(ids)) == len(ids) == 3000 and max(ids) < 2 * len(ids)
    lists = phrases.word_lists(text, found, 4).persist()
    said = phrases.frequent_phrases(lists, 1, 1, 4).persist()
    sent = {"places": 0, "numbers": 0}
    for r in said.where("block IS NOT NULL").collect():
        for c in sent:
            sent[c] += len(r[c])
    pairs = sum(len(set(zip(w, w[1:]))) for w in (r[0].split() for r in rows))  # about; each is frequent at 1
    assert sum(sent.values()) < 4 * pairs
    for df in (text, found, lists, said):
        df.unpersist()
