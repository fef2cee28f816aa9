"""Embedding whitening: leading eigenpairs of a covariance by LOBPCG over distributed block products.

Entries become integers, each different vector counts once in the fit, and the
mean is taken off exactly before anything is multiplied. The driver holds
matrices of one vector's length by three blocks, never rows: each product
V * block is one pass over the rows, whose partial sums meet in a few tasks.

Defined results. Rows whose vector is null, or holds a null or non-finite
entry, go. A null vec_id is an id like any other, repeated rows all come back,
and count once in the fit. Of vectors of several lengths only the most common
length stays (the longer of equally common ones). An empty table gives no rows.
Directions without variance (below FLAT of the whole) have no component, so a
table with one vector, or equal ones, gives no rows either. An entry of 2**40
or more is an error, as its square sums would lose digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Share of the variance under which a direction is rounding, not data.
FLAT = 1e-12
#: A component is certified when |V u - e u| is at most this share of the largest eigenvalue, up to MOST steps.
RESIDUAL, MOST = 1e-11, 500
#: Blocks hold this many directions beyond those asked for, so that close eigenvalues at the cut don't hold up the last ones.
GUARD = 8
#: Tasks in which the partial sums of a pass meet.
MEET = 16


@dataclass
class Whitening:
    """n different vectors with sums S; columns of vectors are components, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    steps: int
    identity_error: float = 0.0


def usable(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding) with finite vectors of the most common length, as packed little-endian doubles."""
    finite = F.expr("embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite).where("size(embedding) > 0")
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return rows.where(F.size("embedding") == F.lit(sizes["d"] if sizes else 0))


def integers(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and np.abs(flat).max() >= 2.0**40:
        raise ValueError("an entry of an embedding is too large to be whitened")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _pack(x: np.ndarray, width: int) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)), pa.py_buffer(x)])


def _unpack(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def fit_list(rows: DataFrame) -> DataFrame:
    """(x) each different integer vector once, as packed int64, in a table of the shared folder; copies meet before the shuffle."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b.column(0))
                yield pa.RecordBatch.from_arrays([_pack(x, 8 * x.shape[1])], ["x"])

    return materialize(rows.select("embedding").mapInArrow(packed, "x binary").distinct(), "whitening-fit")


def total(fit: DataFrame, part, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """The sum of part(rows of x) over all rows, where part gives an array of that shape: one partial a task, summed in MEET tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, dtype=kind)
        for b in batches:
            if b.num_rows:
                out += part(_unpack(b.column(0), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MEET], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slot", "part"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(int(np.prod(shape)), dtype=kind)
        for b in batches:
            for p in b.column(0).to_pylist():
                out += np.frombuffer(p, dtype=kind)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    parts = fit.select("x").mapInArrow(partial, "slot int, part binary").repartition(MEET, "slot").select("part").mapInArrow(meet, "part binary")
    return sum((np.frombuffer(bytes(r[0]), dtype=kind) for r in parts.collect()), np.zeros(int(np.prod(shape)), dtype=kind)).reshape(shape)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean; n * x - S is an exact integer, so nothing is lost to the size of x."""
    return (n * x - sums) / n


def _basis(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks; each block is cleared of those before it, twice, and directions that vanish go."""
    out = np.zeros((len(blocks[0]), 0))
    for b in blocks:
        scale = np.linalg.norm(b, axis=0)
        b = b[:, scale > 0] / scale[scale > 0]
        for _ in range(2):
            b = b - out @ (out.T @ b)
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            b = u[:, s > 1e-10]
        out = np.hstack([out, b])
    return out[:, : len(out)]


def lobpcg(apply, d: int, k: int, seed: int = 0, residual: float = RESIDUAL, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residual norms, steps) of the k largest eigenpairs of the symmetric d x d operator apply(block).

    Rayleigh-Ritz on the span of the iterate, its residuals and the last
    direction. A product is taken of the whole basis in every step, so rounding
    doesn't pile up; when 3 blocks reach d the basis is the whole space.
    """
    m = min(d, k + GUARD)
    basis = _basis(np.random.default_rng(seed).standard_normal((d, m)))
    before = None
    for step in range(1, most + 1):
        image = apply(basis)
        small = basis.T @ image
        e, c = np.linalg.eigh((small + small.T) / 2)
        e, c = e[::-1][:m], c[:, ::-1][:, :m]
        x, vx = basis @ c, image @ c
        r = vx - x * e
        norms = np.linalg.norm(r, axis=0)
        if norms[:k].max() <= residual * max(e[0], 0.0) or basis.shape[1] == d:
            return e[:k], x[:, :k], norms[:k], step
        move = x - before @ (before.T @ x) if before is not None else x[:, :0]
        before = x
        basis = _basis(x, r, move)
    raise RuntimeError(f"components aren't certified after {most} steps: residuals {norms[:k]}")


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Mean and components of rows(vec_id, embedding) that usable() returned; None without rows."""
    first = rows.select(F.size("embedding")).head()
    if first is None:
        return None
    d, table = int(first[0]), fit_list(rows)
    sums = total(table, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), (d + 1,), np.int64)
    n, sums = int(sums[0]), sums[1:]
    trace = float(total(table, lambda x: np.square(centred(x, n, sums)).sum(axis=0), (d,), np.float64).sum()) / n

    def apply(block: np.ndarray) -> np.ndarray:
        return total(table, lambda x: (y := centred(x, n, sums)).T @ (y @ block), block.shape, np.float64) / n

    if trace == 0:
        out = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), trace, np.zeros(0), 0)
    else:
        e, u, norms, steps = lobpcg(apply, d, min(components, d))
        some = e > FLAT * trace
        out = Whitening(n, sums, e[some], u[:, some], trace, norms[some], steps)
    k = len(out.values)
    if k:
        scale = out.vectors / np.sqrt(out.values)
        second = total(table, lambda x: _moments(centred(x, n, sums) @ scale), (k + 1, k), np.float64) / n
        out.identity_error = float(np.abs(second[1:] - np.outer(second[0], second[0]) - np.eye(k)).max())
    discard(table)
    return out


def _moments(z: np.ndarray) -> np.ndarray:
    return np.vstack([z.sum(axis=0), z.T @ z])


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    n, sums, k = model.n, model.sums, len(model.values)
    scale, explained, error = model.vectors / np.sqrt(model.values), model.values / model.trace, model.identity_error

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            exact = n * integers(b.column(1)) - sums
            z = (exact / n) @ scale
            if np.abs(exact).max() < np.sqrt(2.0**63 / exact.shape[1]) - 1:
                deviation = np.square(exact).sum(axis=1)
            else:  # beyond 64 bits on the way; pa.array() raises if the sum is, too
                deviation = np.array([sum(int(v) ** 2 for v in row) for row in exact], dtype=object)
            columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(len(z) * k, n)), pa.array(np.repeat(deviation, k), pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(z) * k, error))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(z)), k))), *columns], names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(whitened, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """rows(vec_id, embedding), each with its first components of unit variance; see the module for odd rows."""
    rows = usable(rows)
    model = fit(rows, components)
    if model is None or not len(model.values):
        model = Whitening(1, np.zeros(1, np.int64), np.zeros(0), np.zeros((1, 0)), 1.0, np.zeros(0), 0)
        rows = rows.where("false")
    return transform(rows, model)
