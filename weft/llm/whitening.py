"""Whitening of embeddings by shifted CholeskyQR.

Vectors become integers, floor(256 * c). The fit list holds each distinct integer vector once. Its centred rows A are
orthogonalised by passes over the data: a pass sums the Gram matrix of Q = A R1^-1 R2^-1 .., got by triangular solves inside
the tasks, and its Cholesky factor is the next R. The first Gram matrix is shifted, so the factor exists however close to
singular it is. The passes end when the Gram matrix is a projector to rounding, which is the identity where A has full rank.
The singular values and right vectors of the composed R are those of A, and neither was taken from a squared matrix.

Odd inputs: a vector that is null or holds nulls, NaN or infinities takes no part. Vectors shorter than the longest count as
filled up with zeros. Repeated rows stay in the result and count once in the fit; a null id is carried. Components of no
variance are not components: of fewer than ``components`` with a positive eigenvalue only those are returned, of an empty
table, or one distinct vector, none. Equal eigenvalues leave the choice of their axes open. An entry beyond a long when
multiplied by 256 counts as the largest long; a deviation beyond a long is null. Columns but the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.moments import array_sum
from weft.llm.workers import ship
from weft.sources.workspace import materialize

COMPONENTS = 4
MAX_PASSES = 6
_U = np.finfo(np.float64).eps / 2
_SAFE = 1 << 62
_OUT = ("component int, n long, deviation long, whitened double, explained double, eigenvalue double, "
        "identity_error double")


@dataclass(frozen=True)
class Whitening:
    """The fit: rows and sums of the fit list, axes (one per column), eigenvalues, their total, and passes taken."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.float64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - part

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.eigenvalues))
        return self.centred(x) @ self.axes[:, :k] / np.sqrt(self.eigenvalues[:k])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the exact sum of (n * x - S) ** 2."""
        top = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1)
        if top * top * max(x.shape[1], 1) < _SAFE:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (d * d).sum(1).tolist()]


def integer_vector(vector: Column) -> Column:
    """floor(256 * c) of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def triangular_solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangular R, column after column for all rows at once."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def upper_factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """R with R'R = gram + shift * I; the shift grows until the factor exists."""
    least = 16 * len(gram) * _U * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(4 * shift, least)


def _sums(distinct: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension, from the sums of high and low halves."""

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(2 * dims + 1, np.int64)
        for x in _matrices(batches, dims):
            total[:dims] += (x >> 32).sum(0)
            total[dims:-1] += (x & 0xFFFFFFFF).sum(0)
            total[-1] += len(x)
        return total if total[-1] else None

    total = array_sum(distinct, task, np.int64)
    if total is None:
        return 0, [0] * dims
    return int(total[-1]), [(int(h) << 32) + int(w) for h, w in zip(total[:dims], total[dims:-1], strict=True)]


def _gram(distinct: DataFrame, dims: int, start: Whitening, factors: list[np.ndarray]) -> np.ndarray:
    """The Gram matrix of the centred rows after the triangular solves."""

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for x in _matrices(batches, dims):
            q = start.centred(x)
            for r in factors:
                q = triangular_solve(q, r)
            total = q.T @ q if total is None else total + q.T @ q
        return None if total is None else total.reshape(-1)

    return array_sum(distinct, task).reshape(dims, dims)


def fit(distinct: DataFrame, dims: int) -> Whitening:
    """Fit on the distinct integer vectors ``x`` of one length."""
    n, sums = _sums(distinct, dims)
    fitted = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0)
    if not n or not dims:
        return fitted
    factors: list[np.ndarray] = []
    composed = np.eye(dims)
    gram = _gram(distinct, dims, fitted, factors)
    trace = float(np.trace(gram))
    if trace <= 0:
        return fitted
    shift = 11 * (float(n) * dims + dims * (dims + 1)) * _U * trace
    while len(factors) < MAX_PASSES:
        factors.append(upper_factor(gram, shift))
        composed = factors[-1] @ composed
        gram, shift = _gram(distinct, dims, fitted, factors), 0.0
        if np.abs(gram @ gram - gram).max() < 64 * dims * _U:
            break
    # Q'Q is a projector P, so A'A = R'PR = (PR)'(PR)
    _, values, right = np.linalg.svd(gram @ composed)
    real = values > 32 * dims * _U * values[0]
    axes = right.T[:, real]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, axes, values[real] ** 2 / n, trace / n, len(factors) + 1)


def identity_error(distinct: DataFrame, dims: int, fitted: Whitening, components: int = COMPONENTS) -> float:
    """Largest entry by which the covariance of the whitened fit list differs from the identity."""
    k = min(components, len(fitted.eigenvalues))

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for x in _matrices(batches, dims):
            w = fitted.whitened(x, components)
            part = np.concatenate([(w.T @ w).reshape(-1), w.sum(0)])
            total = part if total is None else total + part
        return total

    if not k:
        return 0.0
    total = array_sum(distinct, task) / fitted.n
    mean = total[k * k:]
    return float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable row's whitened components; see the module."""
    ship(rows.sparkSession)
    x = rows.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), integer_vector(F.col(vector)).alias("x"))
    x = materialize(x, "integers")
    shortest, dims = (v or 0 for v in x.agg(F.min(F.size("x")), F.max(F.size("x"))).first())
    if shortest < dims:
        x = x.select("id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    distinct = materialize(x.select("x").distinct(), "fit_list")
    fitted = fit(distinct, dims)
    error = identity_error(distinct, dims, fitted, components)
    k = min(components, len(fitted.eigenvalues))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n or not k:
                continue
            m = next(_matrices(iter([batch]), dims))
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(n), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, fitted.n)),
                pa.array([d for d in fitted.deviations(m) for _ in range(k)], pa.int64()),
                pa.array(fitted.whitened(m, components).reshape(-1)),
                pa.array(np.tile(fitted.eigenvalues[:k] / fitted.trace, n)),
                pa.array(np.tile(fitted.eigenvalues[:k], n)), pa.array(np.full(n * k, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"])

    kind = x.schema["id"].dataType.simpleString()
    return x.mapInArrow(task, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)
