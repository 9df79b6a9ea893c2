"""Embedding whitening by a pivoted Cholesky factor and one-sided Jacobi.

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list holds
each distinct x-vector once, so copies weigh nothing. Three narrow passes over
it, each reduced on Spark to numbers that depend on the vectors' length d
alone (d sums, d(d+1)/2 products, 16 x 16 products):

1. n and the exact sums S by dimension;
2. the scatter of the centred vectors: n x - S is formed in whole numbers,
   divided by n and only then multiplied, so the offset costs no digit;
3. the covariance of the whitened vectors, compared with the identity.

Between 2 and 3 the d x d covariance is factored: Cholesky with the largest
remaining diagonal entry as pivot (which stops at the numerical rank), then
Jacobi rotations from the right on the triangular factor's columns until all
are orthogonal. Their squared norms are the eigenvalues, the normalised
columns the components; V itself is never iterated on, so small eigenvalues
keep their digits. Of the input, only these sums reach the driver.

Defined results: rows with a null vector or null or non-finite entries are
dropped; a null or repeated vec_id is a row like any other. Vectors of one
length are whitened among themselves; vectors without entries have no
component and give no row. A component beyond the numerical rank (constant
dimensions, one distinct vector) has a null ``whitened`` and ``explained`` 0;
without any variance ``explained`` and ``identity_error`` are null too.
Entries that no long holds take the nearest one; a deviation that no long
holds is null. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import scaled_vectors, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_SAFE = 2 ** 62


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, pivots): v[pivots][:, pivots] = factor @ factor.T, the factor
    lower triangular with as many columns as ``v`` has numerical rank."""
    d = len(v)
    pivots, left, factor = np.arange(d), v.diagonal().astype(float).copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if left[p] <= least:
            return factor[:, :k], pivots
        for x in (pivots, left, factor):
            x[[k, p]] = x[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        below = slice(k + 1, d)
        factor[below, k] = (v[pivots[below], pivots[k]] - factor[below, :k] @ factor[k, :k]) / factor[k, k]
        left[below] -= factor[below, k] ** 2
    return factor, pivots


def _rounds(n: int):
    """A tournament: every pair of n columns once, in rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1]) if max(a, b) < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until its columns are orthogonal."""
    a = factor.T.copy()         # rows are the columns
    limit = np.finfo(float).eps * max(factor.shape[0], 1)
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(len(a)):
            x, y = a[p], a[q]
            xx, yy, xy = (np.einsum("ij,ij->i", s, t) for s, t in ((x, x), (y, y), (x, y)))
            turn = np.abs(xy) > limit * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            zeta = (yy - xx)[turn] / (2 * xy[turn])
            tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = (1 / np.hypot(1.0, tan))[:, None]
            sin = cos * tan[:, None]
            x, y = x[turn], y[turn]
            a[p[turn]], a[q[turn]] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    return a.T


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and its unit eigenvectors as
    columns (largest absolute entry positive), as many as its rank."""
    factor, pivots = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    columns = np.empty_like(turned)
    columns[pivots] = turned
    norms = np.sqrt(np.einsum("ij,ij->j", columns, columns))
    by = np.argsort(-norms, kind="stable")
    columns, norms = columns[:, by], norms[by]
    if columns.size:
        columns = columns / norms
        columns = columns * np.sign(columns[np.argmax(np.abs(columns), axis=0), np.arange(columns.shape[1])])
    return norms ** 2, columns


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where that holds it, else Python integers."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(z: np.ndarray) -> list[int | None]:
    """Row sums of squares, exact; null beyond a long."""
    most = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
    if z.dtype == object or most ** 2 * z.shape[1] >= _SAFE:
        z = z.astype(object)
    return [int(s) if s < 2 ** 63 else None for s in (z * z).sum(axis=1)]


@dataclass
class Fit:
    """What is known of the fit list's vectors of one length."""
    n: int
    sums: list[int]
    trace: float = 0.0
    values: np.ndarray | None = None
    columns: np.ndarray | None = None
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (deviations(x, self.n, self.sums) / self.n).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.columns / np.sqrt(self.values)


def _packed(batches):
    for b in batches:
        for rows, x in scaled_vectors(b.column(1), SCALE, OFFSET):
            if x.shape[1] and len(rows):
                raw = x.astype("<i8").tobytes()
                w = 8 * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1], np.int32)),
                     pa.array([raw[i:i + w] for i in range(0, len(raw), w)], pa.binary())], ["vec_id", "dim", "x"])


def _matrices(batch):
    """(dim, rows, x) for every length among a batch's packed vectors."""
    dims, raw = batch.column("dim").to_numpy(), batch.column("x").to_pylist()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield d, rows, np.frombuffer(b"".join(raw[i] for i in rows), "<i8").reshape(len(rows), d)


def _moments(batches):
    n, sums = {}, {}
    for b in batches:
        for d, rows, x in _matrices(b):
            safe = len(x) * max(int(x.max()), -int(x.min())) < _SAFE
            n[d] = n.get(d, 0) + len(rows)
            sums[d] = sums.get(d, 0) + (x if safe else x.astype(object)).sum(axis=0).astype(object)
    for d in sorted(n):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n[d])),
                                          pa.array([Decimal(int(s)) for s in sums[d]], pa.decimal128(38, 0))], ["dim", "i", "n", "s"])


def _products(fits: dict[int, Fit], of: str, width):
    """Sums of the products of each two entries of ``of`` over a partition."""
    def run(batches):
        total = {}
        for b in batches:
            for d, _, x in _matrices(b):
                z = getattr(fits[d], of)(x)[:, :width]
                total[d] = total.get(d, 0) + z.T @ z
        for d in sorted(total):
            i, j = np.triu_indices(len(total[d]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[d][i, j])],
                                             ["dim", "i", "j", "s"])
    return run


def _covariances(fit_list: DataFrame, fits: dict[int, Fit], of: str, width=None) -> dict[int, np.ndarray]:
    sums = fit_list.mapInArrow(_products(fits, of, width), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()
    out = {}
    for d in {r.dim for r in sums}:
        own = [r for r in sums if r.dim == d]
        v = np.zeros((max(r.j for r in own) + 1,) * 2)
        for r in own:
            v[r.i, r.j] = v[r.j, r.i] = r.s / fits[d].n
        out[d] = v
    return out


class Whitening:
    """Fitted to the distinct vectors of ``vectors(vec_id, embedding)``."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        self.components = components
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        self.rows = written(rows.mapInArrow(_packed, "vec_id long, dim int, x binary"))
        fit_list = written(self.rows.select("dim", "x").distinct())
        found = fit_list.mapInArrow(_moments, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        self.fits = {d: Fit(next(r.n for r in found if r.dim == d), [int(r.s) for r in sorted((r for r in found if r.dim == d), key=lambda r: r.i)])
                     for d in {r.dim for r in found}}
        for d, v in _covariances(fit_list, self.fits, "centred").items():
            fit = self.fits[d]
            fit.trace = float(np.trace(v))
            fit.values, fit.columns = principal(v)
        for d, v in _covariances(fit_list, self.fits, "whitened", components).items():
            self.fits[d].identity_error = float(np.abs(v - np.eye(len(v))).max())

    def transform(self) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained and
        identity_error: one row for each vector and leading component."""
        fits, most = self.fits, self.components

        def run(batches):
            for b in batches:
                for d, rows, x in _matrices(b):
                    fit, k = fits[d], min(d, most)
                    w = np.full((len(rows), k), np.nan)
                    known = fit.whitened(x)[:, :k]
                    w[:, :known.shape[1]] = known
                    share = [(float(fit.values[c] / fit.trace) if c < len(fit.values) else 0.0) if fit.trace > 0 else None for c in range(k)]
                    each = pa.array(np.repeat(np.arange(len(rows)), k))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), fit.n)),
                         pa.array(squared(deviations(x, fit.n, fit.sums)), pa.int64()).take(each), pa.array(w.ravel(), from_pandas=True),
                         pa.array(share * len(rows), pa.float64()), pa.array([fit.identity_error] * len(each), pa.float64())],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        return self.rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    return Whitening(vectors, components).transform()
