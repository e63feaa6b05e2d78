"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Vectors become whole numbers x. Steps alternate the products t = Xv and Xᵀu over the centred rows, both in one pass over the table: a task holds a batch
of rows and sends sums only. A left vector u has an entry for each row and is never stored; as it lies in the range of X, it is kept as the
combination w with u = Xw. Every new left and right vector is made orthogonal to all earlier ones, twice. The singular value decomposition of the small
bidiagonal matrix gives components and deviations.

Nulls: a row whose vector is null, empty, or holds a null, NaN or infinite entry is left out; a null id passes through. Repeated rows count as often
as they come. An empty table, or one whose vectors are all equal, gives no rows, as components without deviation cannot be whitened; so there are fewer
than the asked components where the covariance has a lower rank. Vectors of different lengths, and entries for which the sum of squares is beyond a long, are errors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqlattice.llm.vector_rows import Batches, stacked, summed, whole_vectors

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: A deviation under this share of the largest counts as none.
NONE = 1e-6
#: A component is settled when the bidiagonal matrix leaves this share of the largest deviation open.
SETTLED = 1e-15


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: rows, sums of each dimension, components in columns, their eigenvalues, the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.values))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less its mean; the difference is taken in whole numbers."""
    return (x * n - sums) / n


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for q in to:
            v = v - q * (q @ v)
    return v


class _Steps:
    """The bidiagonalisation so far: right vectors, left vectors as combinations of the centred rows, and X'u of each."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray) -> None:
        self.rows, self.n, self.sums = rows, n, sums
        self.right: list[np.ndarray] = []
        self.left: list[np.ndarray] = []
        self.back: list[np.ndarray] = []  # X'u
        self.entries: list[tuple[int, int, float]] = []

    def products(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|Xw|^2, X'Xw, and the products of Xw with all left vectors: one pass over the rows."""
        n, sums, basis = self.n, self.sums, np.array([w, *self.left]).T

        def of(b: pa.RecordBatch) -> np.ndarray:
            x = centred(stacked(b.column("x")), n, sums)
            t = x @ basis
            return np.concatenate([t[:, 0] @ t, t[:, 0] @ x])

        found = summed(self.rows, of)
        return float(found[0]), found[len(basis.T) :], found[1 : len(basis.T)]

    def grow(self, v: np.ndarray, scale: float) -> float:
        """Adds the right vector ``v`` and, where Xv holds something new, its left vector; returns the latter's length."""
        j = len(self.right)
        self.right.append(v)
        w, rounds = v, 0
        while True:
            square, back, shared = self.products(w)
            if rounds == 0:
                self.entries += [(i, j, float(c)) for i, c in enumerate(shared) if i == len(self.left) - 1]
            for i, c in enumerate(shared):
                w, back = w - c * self.left[i], back - c * self.back[i]
            rest = square - float(shared @ shared)
            rounds += 1
            # the rest of a difference that cancels is not exact: once more over the rows, for what is left
            if rest > 0.01 * square or rounds == 3:
                break
            if square <= (NONE * 1e-3 * scale) ** 2:
                return 0.0
        length = float(np.sqrt(max(rest, 0.0)))
        if length <= NONE * 1e-3 * scale:
            return 0.0
        self.left.append(w / length)
        self.back.append(back / length)
        self.entries.append((len(self.left) - 1, j, length))
        return length

    def decomposed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        small = np.zeros((len(self.left), len(self.right)))
        for i, j, x in self.entries:
            small[i, j] = x
        return np.linalg.svd(small, full_matrices=False)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """``rows``: (id, x) as ``whole_vectors`` makes them. None without rows."""
    first = summed(rows, lambda b: np.concatenate([[b.num_rows], stacked(b.column("x")).sum(axis=0)]).astype(np.int64))
    if first is None:
        return None
    n, sums = int(first[0]), first[1:]
    d = len(sums)
    widest = int(summed(rows, lambda b: np.abs(stacked(b.column("x"))).max(axis=0), most=True).max())
    if n * widest >= 1 << 61:
        raise ValueError("the sums are beyond 64 bits")
    largest = int(summed(rows, lambda b: np.abs(stacked(b.column("x")) * n - sums).max(axis=0), most=True).max())
    if largest * largest * d >= 1 << 63:
        raise ValueError("a sum of squares is beyond 64 bits")
    trace = float(summed(rows, lambda b: (centred(stacked(b.column("x")), n, sums) ** 2).sum(axis=0)).sum())
    if trace == 0.0:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    steps, scale = _Steps(rows, n, sums), np.sqrt(trace)
    rng = np.random.default_rng(0)
    v, open_ = rng.standard_normal(d), 0.0
    v /= np.linalg.norm(v)
    while True:
        steps.grow(v, scale)
        rest = None
        if len(steps.left) and steps.entries[-1][1] == len(steps.right) - 1 and steps.entries[-1][0] == len(steps.left) - 1:
            rest = _orthogonal(steps.back[-1], steps.right)
            open_ = float(np.linalg.norm(rest))
        if len(steps.right) == d:
            break
        if rest is None or open_ <= NONE * 1e-3 * scale:  # nothing leads on: begin again, at right angles to all that was
            rest = _orthogonal(rng.standard_normal(d), steps.right)
        elif len(steps.right) > components:
            left, sizes, _ = steps.decomposed()
            if (open_ * np.abs(left[-1, : components + 1]) <= SETTLED * sizes[0]).all():
                break
        v = rest / np.linalg.norm(rest)
        v = _orthogonal(v, steps.right)
        v /= np.linalg.norm(v)
    _, sizes, right = steps.decomposed()
    kept = min(components, int((sizes > NONE * sizes[0]).sum())) if len(sizes) else 0
    found = np.array(steps.right).T @ right[:kept].T
    return Whitening(n, sums, found / np.linalg.norm(found, axis=0), sizes[:kept] ** 2 / n, trace / n)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""

    def of(b: pa.RecordBatch) -> np.ndarray:
        z = model.whitened(stacked(b.column("x")))
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = summed(rows, of) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(model.values))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: (id, component, n, deviation, whitened, explained, identity_error). See the module for odd rows."""
    rows = whole_vectors(vectors, id_col, vector, SCALE, SHIFT, "whole")
    model = fit(rows, components)
    schema = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), *[T.StructField(n, t) for n, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)

    def run(batches: Batches) -> Batches:
        for b in batches:
            x = stacked(b.column("x"))
            m, apart = len(x), x * model.n - model.sums
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), pa.array((apart * apart).sum(axis=1)[each]),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))], names=schema.names)

    return rows.mapInArrow(run, schema)
