"""Many cross-validated classifiers over one distributed feature matrix
(M1, M2, M3, M10).

Input
  matrix  ``(dataset, row_id, label INT, fold INT, x ARRAY<DOUBLE>)``; all
          vectors of a dataset have the same length. Rows with a null label,
          fold or vector, or a null or non-finite element, are left out.
  configs ``(config_id STRING, dataset STRING, cols ARRAY<INT>)`` - which
          elements of ``x`` a model uses; every config is fitted once per
          held-out fold (a *fit*). Configs of a dataset without rows give
          no result.
Output
  confusion counts ``(config_id, fold, label, pred, n)`` - every metric
  (fold accuracy, macro F1, histograms) is SQL on this table - or, with
  ``output='oof'``, one out-of-fold prediction per row and config, or, with
  ``output='acc'``, ``(config_id, acc, acc_std, n_folds)``.

One logistic path at every size. The model is the L2 form
``min 0.5/C |coef|^2 + sum of losses`` on standardised columns with an
unpenalised intercept: one weight vector for two classes, one per class
otherwise. The rows lie in blocks of numbers on the executors. Two passes add
the counts, sums and centred cross-products of each fold; from these come the
scaling of every fit (total less held fold) and a fixed upper bound of its
curvature. Then every pass adds the gradients of all open fits, a vector per
block of fits and task, summed by Spark's vector aggregate; the driver holds
weights and the last steps of each fit and moves them by L-BFGS preconditioned
with the bound. No row reaches the driver, no size picks another algorithm.
``STATE_BYTES`` bounds what the driver holds at once: fits beyond it are
fitted one group after the other, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelab.session import cut_lineage, ship_package, spread

#: Bytes of weights, steps and curvature bounds the driver holds at once.
STATE_BYTES = 256 << 20
#: Numbers in one gradient vector, and in one task's table of scores.
SLICE_VALUES = 1 << 16
SCORE_VALUES = 1 << 17
#: Steps an L-BFGS direction remembers, and the expected relative gain at which a fit ends.
MEMORY = 8
TOL = 1e-16
MAX_PASSES = 200
#: Keeps the multinomial intercepts, which a common shift leaves equal, in place.
INTERCEPT_RIDGE = 1e-9

CONFIG_SCHEMA = T.StructType([
    T.StructField("config_id", T.StringType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("cols", T.ArrayType(T.IntegerType()), False),
])
CONFUSION_SCHEMA = "config_id string, fold int, label int, pred int, n bigint"
OOF_SCHEMA = "config_id string, dataset string, row_id bigint, fold int, label int, pred int"
BLOCK_SCHEMA = "dataset string, fold int, n int, x binary, y binary, ids binary"
SUM_SCHEMA = "dataset string, part int, sub int, v array<double>"


def config_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Configs from driver-side design rows ``(config_id, dataset, cols)``."""
    return spark.createDataFrame([(c, d, [int(i) for i in cols]) for c, d, cols in rows], CONFIG_SCHEMA)


def build_matrix(long: DataFrame, folds: DataFrame, qids: Sequence[str]) -> DataFrame:
    """Vector view of the long features joined to labels and folds."""
    from probelab.operators.features import to_array
    return to_array(long, qids).join(folds.select("dataset", "row_id", "label", "fold"),
                                     ["dataset", "row_id"])


def usable(matrix: DataFrame) -> DataFrame:
    """The rows a model can use."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (matrix.select("dataset", "row_id", F.col("label").cast("int").alias("label"),
                          F.col("fold").cast("int").alias("fold"), F.col("x").cast("array<double>").alias("x"))
            .where(F.col("label").isNotNull() & F.col("fold").isNotNull() & F.col("x").isNotNull() & finite))


# ---- blocks and sums -----------------------------------------------------------

def _to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for (ds, fold), g in pdf.groupby(["dataset", "fold"]):
            x = np.stack(g["x"].to_numpy()).astype(np.float64)
            yield pd.DataFrame({"dataset": [ds], "fold": [fold], "n": [len(g)], "x": [x.tobytes()],
                                "y": [g["label"].to_numpy(np.int64).tobytes()],
                                "ids": [g["row_id"].to_numpy(np.int64).tobytes()]})


def _blocks(batches: Iterator[pd.DataFrame]):
    """``(dataset, fold, X, y, row ids)`` of each block."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            yield (r.dataset, int(r.fold), np.frombuffer(r.x).reshape(r.n, -1),
                   np.frombuffer(r.y, np.int64), np.frombuffer(r.ids, np.int64))


def _summed(blocks: DataFrame, partial) -> dict[tuple[str, int, int], np.ndarray]:
    """Sums by ``(dataset, part, sub)`` of the vectors that ``partial(block)``
    yields as ``(part, sub, vector)``: added within a task, then by the vector
    aggregate, which holds one vector a key whatever the number of tasks."""
    def run(batches):
        acc = {}
        for block in _blocks(batches):
            for part, sub, v in partial(block):
                key = (block[0], part, sub)
                acc[key] = acc[key] + v if key in acc else v
        for (ds, part, sub), v in acc.items():
            yield pd.DataFrame({"dataset": [ds], "part": [part], "sub": [sub], "v": [v]})

    rows = (blocks.mapInPandas(run, SUM_SCHEMA).groupBy("dataset", "part", "sub")
            .agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect())
    return {(r["dataset"], r["part"], r["sub"]): r["v"].toArray() for r in rows}


@dataclass
class Shape:
    """What the fits of a dataset share; every array is design-sized."""
    classes: np.ndarray                       # ascending
    centre: np.ndarray                        # mean of all rows, subtracted before summing
    n: dict[int, float] = field(default_factory=dict)             # by held fold: training rows,
    priors: dict[int, np.ndarray] = field(default_factory=dict)   # training rows of each class,
    mean: dict[int, np.ndarray] = field(default_factory=dict)     # training mean less centre,
    scale: dict[int, np.ndarray] = field(default_factory=dict)    # population std, 1 where constant,
    gram: dict[int, np.ndarray] = field(default_factory=dict)     # cross-products of standardised columns

    @property
    def outputs(self) -> int:
        return 1 if len(self.classes) == 2 else len(self.classes)


@dataclass
class Prepared:
    """A matrix in blocks with its shapes; made once, used by many calls."""
    matrix: DataFrame
    blocks: DataFrame
    shapes: dict[str, Shape]
    k: int

    def release(self) -> None:
        self.blocks.unpersist()


def prepare(matrix: DataFrame, k: int = 5) -> Prepared:
    """Lay the matrix out in blocks and add up what the fits share (M1)."""
    ship_package(matrix.sparkSession)
    # few bytes a row, but every pass computes all fits on it; the sums that are
    # shuffled are a vector a fit and task, so tasks don't grow with the rows
    rows = spread(usable(matrix), "row_id", "fold")
    blocks = rows.mapInPandas(_to_blocks, BLOCK_SCHEMA).persist()

    def first(block):
        _, fold, x, y, _ = block
        for c in np.unique(y):
            at = y == c
            yield fold, int(c), np.concatenate([[at.sum()], x[at].sum(axis=0)])

    sums = _summed(blocks, first)
    shapes, counts = {}, {}
    for ds in {key[0] for key in sums}:
        own = {key[1:]: v for key, v in sums.items() if key[0] == ds}
        total = sum(own.values())
        shapes[ds] = Shape(np.array(sorted({c for _, c in own})), total[1:] / total[0])
        counts[ds] = own
    centres = {ds: s.centre for ds, s in shapes.items()}

    def second(block):
        ds, fold, x, _, _ = block
        x = x - centres[ds]
        yield fold, 0, np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    cross = _summed(blocks, second)
    for ds, s in shapes.items():
        d = len(s.centre)
        for held in range(k):
            parts = [v for key, v in cross.items() if key[0] == ds and key[1] != held]
            if not parts:
                continue
            total = sum(parts)
            n, mean = total[0], total[1:d + 1] / total[0]
            cov = total[d + 1:].reshape(d, d) / n - np.outer(mean, mean)
            std = np.sqrt(np.maximum(np.diag(cov), 0))
            scale = np.where(std > 1e-12 * np.maximum(1.0, np.abs(mean + s.centre)), std, 1.0)
            s.n[held], s.mean[held], s.scale[held] = n, mean, scale
            s.gram[held] = n * cov / np.outer(scale, scale)
            s.priors[held] = np.array([sum(v[0] for (f, c), v in counts[ds].items() if f != held and c == cls)
                                       for cls in s.classes])
    return Prepared(matrix, blocks, shapes, k)


# ---- fits ----------------------------------------------------------------------

class Fits:
    """Fits of one dataset. Weights are kept for the elements ``cols`` that any
    of its configs uses (0 where a config doesn't use one), so that a block
    scores all fits in one product."""

    def __init__(self, shape: Shape, keys: list[tuple[str, int, tuple[int, ...]]], lam: float,
                 start: Mapping[tuple[str, int], np.ndarray]):
        self.shape, self.keys, self.lam = shape, keys, lam
        self.cols = np.array(sorted({c for _, _, cols in keys for c in cols}), dtype=np.int64)
        self.centre = shape.centre[self.cols]
        place = {int(c): i for i, c in enumerate(self.cols)}
        count, d, q = len(keys), len(self.cols), shape.outputs
        self.d, self.q = d, q
        self.held = np.array([h for _, h, _ in keys])
        self.mask = np.zeros((count, d))
        for i, (_, _, cols) in enumerate(keys):
            self.mask[i, [place[c] for c in cols]] = 1.0
        self.mean = np.stack([shape.mean[h][self.cols] for h in self.held])
        self.scale = np.stack([shape.scale[h][self.cols] for h in self.held])
        self.penalty = np.full(d + 1, lam)
        self.penalty[d] = 0.0 if q == 1 else INTERCEPT_RIDGE
        bound = 0.25 if q == 1 else 0.5
        self.inverse = np.empty((count, d, d))
        for i in range(count):
            used = self.mask[i]
            a = bound * shape.gram[self.held[i]][np.ix_(self.cols, self.cols)] * np.outer(used, used) + np.diag(np.where(used > 0, lam, 1.0))
            self.inverse[i] = np.linalg.inv(a) * np.outer(used, used)
        rows = np.array([shape.n[h] for h in self.held])
        self.inverse_intercept = 1.0 / (bound * rows + INTERCEPT_RIDGE)
        self.w = np.zeros((count, q, d + 1))
        for i, (config, h, _) in enumerate(keys):
            prior = np.log(np.maximum(shape.priors[h], 0.5))
            self.w[i, :, d] = prior[-1] - prior[0] if q == 1 else prior - prior.mean()
            known = start.get((config, h))
            if known is not None:
                self.w[i] = known[:, [*self.cols, -1]]
        size = q * (d + 1)
        self.accepted = self.w.copy()
        self.value = np.full(count, np.inf)
        self.grad = np.zeros((count, q, d + 1))
        self.step = np.zeros((count, q, d + 1))
        self.length = np.ones(count)
        self.moves = np.zeros((count, MEMORY, size))
        self.turns = np.zeros((count, MEMORY, size))
        self.open = np.full(count, len(shape.classes) > 1)

    @staticmethod
    def state_bytes(shape: Shape) -> int:
        d, size = len(shape.centre), shape.outputs * (len(shape.centre) + 1)
        return 8 * (d * d + size * (2 * MEMORY + 6))

    def full(self, i: int) -> np.ndarray:
        """Weights of a fit for all elements of the dataset."""
        out = np.zeros((self.q, len(self.shape.centre) + 1))
        out[:, [*self.cols, -1]] = self.w[i]
        return out

    def raw(self, at: np.ndarray) -> np.ndarray:
        """Weights for centred, unscaled columns; the intercept is last."""
        u = self.w[at, :, :self.d] * (self.mask[at] / self.scale[at])[:, None, :]
        shift = self.w[at, :, self.d] - np.einsum("fqd,fd->fq", u, self.mean[at])
        return np.concatenate([u, shift[:, :, None]], axis=2)

    def precondition(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        out[:, :, :self.d] = np.einsum("fde,fqe->fqd", self.inverse[at], v[:, :, :self.d])
        out[:, :, self.d] = v[:, :, self.d] * self.inverse_intercept[at][:, None]
        return out

    def direction(self, at: np.ndarray) -> np.ndarray:
        """L-BFGS direction of the fits ``at``; forgotten steps are zeros."""
        g = self.grad[at]
        size = self.q * (self.d + 1)
        flat = g.reshape(len(at), size).copy()
        s, y = self.moves[at], self.turns[at]
        sy = np.einsum("fmp,fmp->fm", s, y)
        rho = np.where(sy > 0, 1.0 / np.where(sy > 0, sy, 1.0), 0.0)
        alphas = np.zeros((len(at), MEMORY))
        for m in range(MEMORY - 1, -1, -1):
            alphas[:, m] = rho[:, m] * np.einsum("fp,fp->f", s[:, m], flat)
            flat -= alphas[:, m, None] * y[:, m]
        last = self.precondition(at, y[:, -1].reshape(g.shape)).reshape(len(at), size)
        curved = np.einsum("fp,fp->f", y[:, -1], last)
        gamma = np.where(curved > 0, sy[:, -1] / np.where(curved > 0, curved, 1.0), 1.0)
        flat = self.precondition(at, flat.reshape(g.shape)).reshape(len(at), size) * gamma[:, None]
        for m in range(MEMORY):
            beta = rho[:, m] * np.einsum("fp,fp->f", y[:, m], flat)
            flat += (alphas[:, m] - beta)[:, None] * s[:, m]
        return -flat.reshape(g.shape)

    def move(self, at: np.ndarray, sums: np.ndarray) -> None:
        """Take the data terms at the tried weights: accept or halve the step,
        close what has come to its end, set the next weights to try."""
        d, q = self.d, self.q
        raw = sums[:, :-1].reshape(len(at), q, d + 1)
        w = self.w[at]
        grad = raw.copy()
        grad[:, :, :d] = ((raw[:, :, :d] - self.mean[at][:, None, :] * raw[:, :, d:])
                          * (self.mask[at] / self.scale[at])[:, None, :])
        grad += self.penalty * w
        value = sums[:, -1] + 0.5 * np.sum(self.penalty * w * w, axis=(1, 2))
        slope = np.sum(self.grad[at] * self.step[at], axis=(1, 2))
        fits = (~np.isfinite(self.value[at])
                | (value <= self.value[at] + 1e-4 * self.length[at] * slope + 1e-14 * np.abs(value)))
        tiny = self.length[at] < 1e-10
        self.open[at[tiny & ~fits]] = False                    # no decrease left in double precision
        back = at[~fits & ~tiny]
        self.length[back] *= 0.5
        ok = at[fits]
        size = q * (d + 1)
        s = (self.w[ok] - self.accepted[ok]).reshape(len(ok), size)
        y = (grad[fits] - self.grad[ok]).reshape(len(ok), size)
        learnt = np.isfinite(self.value[ok]) & (np.einsum("fp,fp->f", s, y) > 1e-300)
        push = ok[learnt]
        self.moves[push] = np.concatenate([self.moves[push][:, 1:], s[learnt][:, None]], axis=1)
        self.turns[push] = np.concatenate([self.turns[push][:, 1:], y[learnt][:, None]], axis=1)
        self.accepted[ok], self.grad[ok], self.value[ok], self.length[ok] = self.w[ok], grad[fits], value[fits], 1.0
        self.step[ok] = self.direction(ok)
        gain = -np.sum(self.grad[ok] * self.step[ok], axis=(1, 2))
        self.open[ok[gain <= TOL * np.maximum(1.0, value[fits])]] = False
        self.w[at] = self.accepted[at] + self.length[at][:, None, None] * self.step[at]
        shut = at[~self.open[at]]
        self.w[shut] = self.accepted[shut]


def _scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(outputs, fits, rows) of centred rows: what is added or compared lies
    along the rows."""
    fits, q, width = weights.shape
    flat = weights.transpose(1, 0, 2).reshape(q * fits, width)
    return (flat[:, :-1] @ x.T + flat[:, -1:]).reshape(q, fits, len(x))


def _data_terms(x: np.ndarray, yi: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per fit the gradient by output and column (intercept last) and the loss."""
    e = _scores(x, weights)
    q, fits, rows = e.shape
    if q == 1:
        target = (yi == 1).astype(float)
        loss = (np.logaddexp(0.0, e[0]) - target * e[0]).sum(axis=1)
        r = (0.5 * (1.0 + np.tanh(0.5 * e[0])) - target)[None]
    else:
        e -= e.max(axis=0)
        own = e[yi, :, np.arange(rows)]                 # (rows, fits)
        r = np.exp(e, out=e)
        total = r.sum(axis=0)
        loss = np.log(total).sum(axis=1) - own.sum(axis=0)
        r /= total
        r[yi, :, np.arange(rows)] -= 1.0
    flat = r.reshape(q * fits, rows)
    grad = np.concatenate([flat @ x, flat.sum(axis=1)[:, None]], axis=1).reshape(q, fits, -1)
    return np.concatenate([grad.transpose(1, 0, 2).reshape(fits, -1), loss[:, None]], axis=1)


def _one_pass(prep: Prepared, groups: Mapping[str, Fits]) -> bool:
    """One gradient pass over all open fits; false when none is open."""
    todo = {ds: np.flatnonzero(f.open) for ds, f in groups.items()}
    todo = {ds: at for ds, at in todo.items() if len(at)}
    if not todo:
        return False
    design = {ds: (groups[ds].cols, groups[ds].centre, prep.shapes[ds].classes, groups[ds].held[at], groups[ds].raw(at))
              for ds, at in todo.items()}
    sent = prep.blocks.sparkSession.sparkContext.broadcast(design)    # bounded by STATE_BYTES

    def partial(block):
        ds, fold, x, y, _ = block
        if ds not in sent.value:
            return
        cols, centre, classes, held, weights = sent.value[ds]
        x, yi = x[:, cols] - centre, np.searchsorted(classes, y)
        fits, q, width = weights.shape
        per_slice = max(1, SLICE_VALUES // (q * width + 1))
        per_rows = max(1, SCORE_VALUES // (min(per_slice, fits) * q))
        for sub in range(0, fits, per_slice):
            at = np.flatnonzero(held[sub:sub + per_slice] != fold)
            if not len(at):
                continue
            v = np.zeros((min(per_slice, fits - sub), q * width + 1))
            for r in range(0, len(x), per_rows):
                v[at] += _data_terms(x[r:r + per_rows], yi[r:r + per_rows], weights[sub + at])
            yield 0, sub, v.ravel()

    sums = _summed(prep.blocks, partial)
    sent.unpersist()
    for ds, at in todo.items():
        f = groups[ds]
        width = f.q * (f.d + 1) + 1
        f.move(at, np.concatenate([sums[key].reshape(-1, width) for key in sorted(sums) if key[0] == ds]))
    return True


def _fit(prep: Prepared, fits: list[tuple], lam: float, start: Mapping) -> dict[str, Fits]:
    """Fit ``(config_id, dataset, held, cols)`` together."""
    by_dataset: dict[str, list] = {}
    for config, ds, held, cols in fits:
        by_dataset.setdefault(ds, []).append((config, held, cols))
    groups = {ds: Fits(prep.shapes[ds], keys, lam, start) for ds, keys in by_dataset.items()}
    for _ in range(MAX_PASSES):
        if not _one_pass(prep, groups):
            break
    for f in groups.values():
        f.w = f.accepted
    return groups


def _predict(prep: Prepared, groups: Mapping[str, Fits], output: str) -> DataFrame:
    """Predictions of the held folds; ties go to the lowest class."""
    design = {ds: (f.cols, f.centre, prep.shapes[ds].classes, f.held, [c for c, _, _ in f.keys],
                   f.raw(np.arange(len(f.held)))) for ds, f in groups.items()}
    sent = prep.blocks.sparkSession.sparkContext.broadcast(design)

    def run(batches):
        counts: dict[tuple, int] = {}
        for ds, fold, x, y, ids in _blocks(batches):
            if ds not in sent.value:
                continue
            cols, centre, classes, held, names, weights = sent.value[ds]
            at = np.flatnonzero(held == fold)
            x, size = x[:, cols] - centre, max(1, SCORE_VALUES // max(1, len(x) * weights.shape[1]))
            for sub in range(0, len(at), size):
                some = at[sub:sub + size]
                e = _scores(x, weights[some])
                if len(classes) == 2:
                    picked = (e[0] > 0).astype(np.int64)
                else:
                    picked = np.argmax(e, axis=0)
                for j, i in enumerate(some):
                    pred = classes[picked[j]]
                    if output == "oof":
                        yield pd.DataFrame({"config_id": names[i], "dataset": ds, "row_id": ids, "fold": fold,
                                            "label": y, "pred": pred})
                        continue
                    many = len(classes)
                    n = np.bincount(np.searchsorted(classes, y) * many + picked[j], minlength=many * many)
                    for pair in np.flatnonzero(n):
                        key = (names[i], fold, int(classes[pair // many]), int(classes[pair % many]))
                        counts[key] = counts.get(key, 0) + int(n[pair])
        if counts:
            yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["config_id", "fold", "label", "pred", "n"])

    if output == "oof":
        return prep.blocks.mapInPandas(run, OOF_SCHEMA)
    return (prep.blocks.mapInPandas(run, CONFUSION_SCHEMA)
            .groupBy("config_id", "fold", "label", "pred").agg(F.sum("n").alias("n")))


def fit_and_predict(prep: Prepared, configs: Sequence[tuple], C: float = 1.0, output: str = "confusion",
                    start: Mapping[tuple[str, int], np.ndarray] | None = None,
                    state_bytes: int | None = None) -> tuple[DataFrame, dict[tuple[str, int], np.ndarray]]:
    """All fits of ``configs`` (rows ``(config_id, dataset, cols)``), in groups
    whose state fits ``state_bytes``. Returns predictions or counts and the
    weights by ``(config_id, held fold)``, with which a later call may start."""
    spark = prep.blocks.sparkSession
    budget = state_bytes or STATE_BYTES
    fits = [(c, ds, held, tuple(cols)) for c, ds, cols in configs if ds in prep.shapes
            for held in range(prep.k) if held in prep.shapes[ds].n]
    out, weights, group, used = [], {}, [], 0
    for f in [*fits, None]:
        size = Fits.state_bytes(prep.shapes[f[1]]) if f else 0
        if group and (f is None or used + size > budget):
            done = _fit(prep, group, 1.0 / C, start or {})
            out.append(_predict(prep, done, output))
            for d in done.values():
                weights.update({(c, h): d.full(i) for i, (c, h, _) in enumerate(d.keys)})
            group, used = [], 0
        if f:
            group.append(f)
            used += size
    if not out:
        return spark.createDataFrame([], OOF_SCHEMA if output == "oof" else CONFUSION_SCHEMA), weights
    res = out[0]
    for more in out[1:]:
        res = res.unionByName(more)
    return res, weights


# ---- perceptron ----------------------------------------------------------------

def _perceptron(prep: Prepared, configs: Sequence[tuple], output: str, mlp_kw: Mapping, parallelism: int = 4) -> DataFrame:
    """Spark ML's data-parallel perceptron (one hidden layer, L-BFGS) per
    fit, on rows standardised by the fit's training folds; independent fits
    are submitted side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.classification import MultilayerPerceptronClassifier

    # dealt over all cores and written once: fits and predictions read it many times
    rows_all = cut_lineage(spread(usable(prep.matrix), "row_id", "fold"))
    hidden = int(mlp_kw.get("hidden", 64))

    def fit_one(fit):
        config, ds, cols, held = fit
        s = prep.shapes[ds]
        mu, sc = s.mean[held] + s.centre, s.scale[held]
        cls = [int(c) for c in s.classes]
        known = F.array(*[F.lit(c) for c in cls])
        feats = array_to_vector(F.array(*[(F.col("x")[c] - float(mu[c])) / float(sc[c]) for c in cols]))
        rows = rows_all.where(F.col("dataset") == ds).select(
            "row_id", "label", "fold", feats.alias("features"),
            (F.array_position(known, F.col("label")) - 1).cast("double").alias("y"))
        # the network has two outputs at least; a single class is then output 0
        model = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y",
                                               layers=[len(cols), hidden, max(2, len(cls))],
                                               maxIter=int(mlp_kw.get("max_iter", 200)),
                                               seed=int(mlp_kw.get("seed", 0))).fit(rows.where(F.col("fold") != held))
        return (model.transform(rows.where(F.col("fold") == held))
                     .select(F.lit(config).alias("config_id"), F.lit(ds).alias("dataset"), "row_id",
                             F.lit(held).alias("fold"), "label",
                             F.element_at(known, F.col("prediction").cast("int") + 1).alias("pred")))

    fits = [(c, ds, [int(i) for i in cols], h) for c, ds, cols in configs if ds in prep.shapes
            for h in range(prep.k) if h in prep.shapes[ds].n]
    with ThreadPoolExecutor(max_workers=max(1, min(len(fits), parallelism))) as ex:
        preds = list(ex.map(fit_one, fits))
    out = prep.blocks.sparkSession.createDataFrame([], OOF_SCHEMA)
    for p in preds:
        out = out.unionByName(p)
    if output == "oof":
        return out
    return out.groupBy("config_id", "fold", "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def evaluate_many(matrix: DataFrame | None, configs: DataFrame, *, k: int = 5, classifier: str = "logreg",
                  C: float = 1.0, output: str = "confusion", prepared: Prepared | None = None,
                  state_bytes: int | None = None, mlp_kw: dict | None = None) -> DataFrame:
    """M3: fit every config on k-1 folds and predict the held fold, for all k.

    ``prepared`` is a handle from ``prepare``, for several calls over one
    matrix; the caller releases it."""
    if classifier not in ("logreg", "mlp"):
        raise ValueError(f"unknown classifier {classifier!r}: logreg or mlp")
    prep = prepared or prepare(matrix, k)
    try:
        rows = [(r["config_id"], r["dataset"], r["cols"]) for r in configs.collect()]     # design table
        kind = "oof" if output == "oof" else "confusion"
        if classifier == "mlp":
            res = _perceptron(prep, rows, kind, mlp_kw or {})
        else:
            res = fit_and_predict(prep, rows, C, kind, state_bytes=state_bytes)[0]
        if kind == "confusion":
            # configs x folds x classes^2 rows whatever the row count: made
            # once, so that accuracy and F1 don't predict again
            res = res.persist()
            res.count()
    finally:
        if prepared is None:
            prep.release()
    if output == "acc":
        from probelab.operators.metrics import cv_accuracy
        return cv_accuracy(res)
    return res
