import numpy as np
import pytest

from factmill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, dim int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16))
    for i in range(300, 500):  # near copies, in groups
        x[i] = x[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2])
    x[500:560] = x[0]
    return x.astype(np.float32)


def brute(rows):
    ids = [i for i, v in rows if usable(v)]
    x = np.array([np.asarray(v, dtype=float) / np.linalg.norm(np.asarray(v, dtype=float)) for _, v in rows if usable(v)])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = embeddings.forest(len(ids), *np.nonzero(near))
    return {i: (int(n), ids[r]) for i, n, r in zip(ids, near.sum(1), label, strict=True)}


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_links(spark, vectors):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan"), *[1.0] * 15]), (5004, [None, *[1.0] * 15]), (5005, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows + odd] + [(None, [1.0] * 16, 0, 1)], SCHEMA)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows) + len(odd) + 1
    found, true = sum(got[i].n_links for i in want), sum(n for n, _ in want.values())
    assert true > 1000 and found <= true and found >= 0.9 * true
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) >= 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert got[None].kept and got[None].component_id is None


def test_oversized_shards_are_dealt_to_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "CAP", 60)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors[:400])]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert all(got[i] <= n for i, (n, _) in want.items()) and sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_other_dimensions_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, 1), (2, [1.0, 0.001], 0, 1), (3, [1.0, 0.0, 0.0], 0, 1)], SCHEMA)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pruned_graph_search_finds_neighbours(vectors):
    x = vectors[:300].astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = embeddings.build(x)
    q, n = embeddings.search(x, x, lists, 0.5)
    true = (x @ x.T >= 0.5).sum()
    assert len(q) >= 0.9 * true and len(set(zip(q.tolist(), n.tolist(), strict=True))) == len(q)


@pytest.mark.parametrize("size", [100, 300, 600])
def test_search_leaves_and_enters_groups_larger_than_the_lists(size):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 64))
    x[:size] = x[0] + rng.normal(size=(size, 64)) * 0.05  # near copies, each with more of them than NEAREST
    x[size : size + 60] = x[0] + rng.normal(size=64) * 0.35 + rng.normal(size=(60, 64)) * 0.02  # a second group beside it
    for i in range(900, 1000, 2):
        x[i + 1] = x[i] + rng.normal(size=64) * 0.1  # unrelated pairs
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, n = embeddings.search(x, x, embeddings.build(x), 0.9)
    true = x @ x.T >= 0.9
    found = np.zeros_like(true)
    found[q, n] = True
    assert size > embeddings.NEAREST and not (found & ~true).any()
    assert (found.sum(1) / true.sum(1)).min() == 1


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 32))
    x[:300] = x[0] + rng.normal(size=(300, 32)) * 0.02
    x[401:500:2] = x[400:500:2] + rng.normal(size=(50, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    units = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, unit array<double>")
    true = (x @ x.T >= 0.9).sum(1) - 1
    links = lambda n: spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "vec_id long, n_links long")
    assert embeddings.audit(units, links(true)) == 1
    assert embeddings.audit(units, links(np.where(np.arange(500) < 300, true, 0))) < 0.1
    assert embeddings.audit(units, links(np.zeros(500))) == 0


def test_what_the_search_misses_at_most_overlap_is_completed(spark, vectors, monkeypatch):
    tried = []

    def nothing(reps, n, dim, overlap, least, name):
        tried.append(overlap)
        return spark.createDataFrame([], "vec_id long, links long, pairs long, root long")

    monkeypatch.setattr(embeddings, "near_pairs", nothing)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    real = embeddings.exact_pairs
    monkeypatch.setattr(embeddings, "exact_pairs", lambda reps, n, dim, least: real(reps, n * 3, dim, least))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)).collect()}
    assert tried == [3, 6, 8] and got == brute(rows)


def test_exact_comparison_between_blocks(spark, vectors):
    x = np.unique(vectors.astype(float), axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    reps = spark.createDataFrame([(i, 2, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, weight long, unit array<double>")
    got = embeddings.exact_pairs(reps, 200_000, 16, 0.9).groupBy("vec_id").agg({"links": "sum", "pairs": "sum"}).collect()
    assert {r.vec_id: (r["sum(links)"], r["sum(pairs)"]) for r in got} == {i: (2 * n, n) for i, n in enumerate(near.sum(1).tolist()) if n}
