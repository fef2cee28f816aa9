"""Trained operators: held-out accuracy on given tables, and defined results for odd rows."""

import math
import zlib

import numpy as np
import pytest

from factmill.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_language(real, docs, corpus, empty):
    rows, _ = real
    model = langid.train(rows)
    told = langid.predict(rows, model).where("held_out").join(rows.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in told]) >= 0.98
    odd = langid.predict(docs, model).collect()
    assert len(odd) == len(corpus)
    by = {r.doc_id: r for r in odd}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002, 1003, 1008))
    assert all(0 <= r.score <= 1 and r.lang_pred in (*model.langs, "und") for r in odd)
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 7, 12, 40])
def test_codewords_are_apart(k):
    code = langid.code_matrix(k)
    assert len({tuple(r) for r in code.tolist()}) == k
    apart = (code[:, None] != code[None]).sum(2)
    assert (apart[~np.eye(k, dtype=bool)] >= (1 if k == 2 else code.shape[1] // 4)).all()


def test_toxicity(spark, docs, corpus, empty):
    rows, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(rows, toxicity.train(rows, labels)).join(rows.select("doc_id", "text"), "doc_id").where("held_out").collect()
    words = ("idiot", "moron", "stupid", "pathetic", "worthless", "scum", "loser", "clown", "trash", "disgusting")
    bad = [r.predicted for r in scored if sum(w in r.text.lower().split() for w in words) >= 2]
    good = [r.predicted for r in scored if not any(w in r.text.lower() for w in words)]
    assert np.mean(bad) >= 0.9 and np.mean(good) <= 0.03
    odd = toxicity.score(docs, toxicity.train(rows, labels)).collect()
    assert len(odd) == len(corpus) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0}


def counts(text):
    words, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else set(windows)
    covered = {k + j for k, w in enumerate(windows) if w in again for j in range(8)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, corpus):
    want = sorted((r[0] or -1, *counts(r[1] or "")) for r in corpus)
    got = quality.measure(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def binomial(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k, n", [(0, 20), (1, 20), (5, 100), (30, 400)])
def test_exact_bound(k, n):
    assert binomial(k, n, quality.upper_bound(k, n, 0.01)) == pytest.approx(0.01, rel=1e-3)


def test_walk_keeps_the_risk():
    rejecting = np.zeros(quality.STEPS, dtype=int)
    rejecting[10:] = 1
    assert quality.walk(rejecting, 20, 0.01, 0.05) is None  # 20 good documents prove nothing
    got = quality.GRID.index(quality.walk(rejecting, 500, 0.01, 0.05))
    assert quality.upper_bound(got - 9, 500, 0.01) <= 0.05 < quality.upper_bound(got - 8, 500, 0.01)
    rejecting[3] = 400  # nothing behind a step that fails counts
    assert quality.walk(rejecting, 500, 0.01, 0.05) == quality.GRID[2]


def brute_kept(rows, labels):
    """kept by the definition, in plain Python, from measured rows."""
    best = {}
    for doc, q in labels:
        if doc is not None and q is not None:
            best[doc] = max(q, best.get(doc, 0))
    values = lambda r: [r.n_symbols / max(r.word_chars, 1), r.n_dup_lines / max(r.n_lines, 1), r.n_repeat_words / max(r.n_words, 1), r.n_upper / max(r.word_chars, 1), r.n_marks / max(r.word_chars, 1), r.n_digits / max(r.word_chars, 1)]
    base = lambda r: r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
    good = [r for r in rows if not base(r) and best.get(r.doc_id) == 1]
    held = lambda r: zlib.crc32(f"part {r.doc_id}".encode()) % 3 > 0
    strata = {r.stratum for r in good}
    cuts = {}
    for s in strata:
        first, second = ([values(r) for r in good if r.stratum == s and held(r) == h] for h in (False, True))
        if not first:
            continue
        unit = [max(*(v[i] for v in first), 0.001) if len(first) > 1 else max(first[0][i], 0.001) for i in range(6)]
        over = [max(x / u for x, u in zip(v, unit, strict=True)) for v in second]
        for cut in quality.GRID:
            k, n = sum(x > cut for x in over), len(over)
            if not n or k == n or binomial(k, n, quality.RISK) > quality.DELTA / len(strata):
                break
            cuts[s] = (cut, unit)
    kept = []
    for r in rows:
        cut = cuts.get(r.stratum)
        kept.append((r.doc_id, not base(r) and (cut is None or max(x / u for x, u in zip(values(r), cut[1], strict=True)) <= cut[0])))
    return cuts, sorted(kept, key=repr)


def test_quality_kept_by_brute_force(real):
    rows, labels = real
    measured = quality.measure(rows).collect()
    cuts, want = brute_kept(measured, [(r.doc_id, r.quality) for r in labels.collect()])
    assert cuts  # the method acts
    got = quality.rules(rows, labels)
    assert sorted(((r.doc_id, r.kept) for r in got.collect()), key=repr) == want
    assert got.where("failed_rule IS NOT NULL AND NOT base_failed").count() > 0


def test_quality_guarantee_on_fresh_rows(spark):
    """Thirty strata with cutoffs learned from a part of their rows: none loses more of the others than the risk."""
    rng = np.random.default_rng(5)
    zero = dict.fromkeys(quality.COUNTS, 0)
    rows = [{"doc_id": i, "stratum": f"s{i % 30}", **zero, "n_words": 100, "word_chars": 500, "n_lines": 10, "n_symbols": int(rng.geometric(0.05)), "n_digits": int(rng.geometric(0.02))} for i in range(30 * 1500)]
    frame = spark.createDataFrame(rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in quality.COUNTS))
    learned = {r.stratum: r for r in quality.calibrate(frame, spark.createDataFrame([(i, 1) for i in range(30 * 500)], "doc_id long, quality int")).collect()}
    assert len(learned) == 30
    for s, cut in learned.items():
        fresh = [r for r in rows[30 * 500 :] if r["stratum"] == s]
        lost = np.mean([max(r["n_symbols"] / 500 / cut.unit_symbols, r["n_digits"] / 500 / cut.unit_digits) > cut.cut for r in fresh])
        assert 0 < lost <= quality.RISK


def test_quality_rules(spark, real, docs, corpus, empty):
    rows, labels = real
    got = quality.rules(rows, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1 and not r.base_failed]
    assert np.mean(good) >= 0.95
    odd = quality.rules(docs, spark.createDataFrame([(None, 1, 0), (5, None, 0), (6, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(odd) == len(corpus)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in odd)
    assert quality.rules(empty, labels).count() == 0
