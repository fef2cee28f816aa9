import numpy as np
import pytest

from factmill.llm import whitening

KIND = "vec_id long, embedding array<float>, component string, n string, rank int"
D = 24


def vectors(n: int, seed: int = 2) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, D)) * np.linspace(0.2, 3, D)).astype(np.float32).tolist()


@pytest.fixture(scope="module")
def rows():
    v = vectors(150)
    odd = [(1000, None), (1001, [None, *v[0][1:]]), (1002, [float("nan"), *v[0][1:]]), (1003, [float("inf"), *v[0][1:]]), (1004, []), (1005, [1.0, 2.0]), (None, v[3]), (7, v[7]), (7, v[7])]
    return [(i, x, "c", "n", 0) for i, x in [*enumerate(v), *odd]]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def expected(kept: list[list[float]], k: int):
    x = np.floor(64 * np.array(kept, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    return n, np.square(n * x - sums).sum(axis=1), (n * x - sums) / n @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("k", [3, 16])
def test_whitened_rows_are_those_of_a_dense_solver(table, rows, k):
    kept = [(r[0], r[1]) for r in rows if r[1] and len(r[1]) == D and all(c is not None and np.isfinite(c) for c in r[1])]
    n, deviation, z, explained = expected([x for _, x in kept], k)
    got = whitening.whiten(table, k).collect()
    assert len(got) == k * len(kept) and {r.n for r in got} == {n} and got[0].identity_error < 1e-12
    by = {}
    for r in got:
        by.setdefault((r.vec_id if r.vec_id is not None else -1, r.component), r)
    for (i, _), dev, row in zip(kept, deviation, z):
        for c in range(k):
            r = by[(-1 if i is None else i, c + 1)]
            assert r.deviation == dev and abs(abs(r.whitened) - abs(row[c])) < 1e-9 and abs(r.explained / explained[c] - 1) < 1e-9
    for c in range(k):  # one sign for all rows
        signs = {np.sign(by[(i, c + 1)].whitened * row[c]) for (i, _), row in zip(kept, z) if i is not None and abs(row[c]) > 1e-6}
        assert len(signs) == 1


def test_lobpcg_where_blocks_do_not_span_the_space():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 150))
    v = a.T @ a
    e, u, residuals, steps = whitening.lobpcg(lambda b: v @ b, 150, 5)
    want, vectors = np.linalg.eigh(v)
    assert 3 < steps < whitening.MOST and residuals.max() <= whitening.RESIDUAL * e[0]
    assert np.allclose(e, want[::-1][:5], rtol=1e-12) and np.allclose(np.abs(np.sum(u * vectors[:, ::-1][:, :5], axis=0)), 1, atol=1e-12)


def test_equal_eigenvalues_and_no_certificate():
    e, u, _, _ = whitening.lobpcg(lambda b: 2.0 * b, 40, 3)
    assert np.allclose(e, 2) and np.allclose(u.T @ u, np.eye(3))
    v = np.diag(np.linspace(1, 2, 500))
    with pytest.raises(RuntimeError, match="certified"):
        whitening.lobpcg(lambda b: v @ b, 500, 4, most=2)


def test_flat_directions_have_no_component(spark):
    flat = [(i, [float(i % 5), float(i // 5), 0.0], None, None, None) for i in range(25)]
    got = whitening.whiten(spark.createDataFrame(flat, KIND)).collect()
    assert {r.component for r in got} == {1, 2} and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    same = spark.createDataFrame([(i, [1.0, 2.0], None, None, None) for i in range(4)], KIND)
    assert not whitening.whiten(same).collect() and not whitening.whiten(same.limit(1)).collect()


def test_empty_table_and_large_entries(spark):
    assert not whitening.whiten(spark.createDataFrame([], KIND)).collect()
    big = spark.createDataFrame([(1, [1e15, 0.0], None, None, None), (2, [1.0, 0.0], None, None, None)], KIND)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(big).collect()
    far = spark.createDataFrame([(1, [1e7, 0.0], None, None, None), (2, [-1e7, 1.0], None, None, None), (3, [0.0, 3.0], None, None, None)], KIND)
    rows = whitening.whiten(far).collect()
    x = np.floor(64 * np.array([[1e7, 0], [-1e7, 1], [0, 3]], dtype=np.float32).astype(float)).astype(int) + 10**6
    assert {r.vec_id: r.deviation for r in rows} == {i + 1: sum((3 * int(v) - int(s)) ** 2 for v, s in zip(x[i], x.sum(axis=0))) for i in range(3)}
