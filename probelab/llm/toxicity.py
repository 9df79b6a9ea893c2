"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the presence of words and of word beginnings of 4 to 7
letters (inflected and compound forms share them) is fitted on labelled
documents.
Every training text also has a counterfactual: the same text with its
identity terms swapped within their group. The loss adds ``swap_weight``
times the squared difference of the two scores, so a group's name alone
cannot carry a score.

Bounds of the fit, all parameters: at most ``max_rows`` labelled rows (those
of the smallest hash of doc_id), at most ``max_features`` features (the
strongest association with the label among those of at least ``min_docs``
training documents; identity terms always belong). Counts and gradients are
Spark aggregates over the training rows; the driver holds one weight a feature.
Scoring reads every whole text once, without a shuffle.

Defined results: empty and null texts score the model's bias. Rows without a
label, or labelled both ways, teach nothing. Without a toxic or a clean
training row the score is the share of toxic rows (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import written

# Identity terms, one group a line; a term swaps with the next of its group.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("she", "he"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "abled"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


BEGINNINGS = (4, 5, 6, 7)


def features(present: set[str]) -> set[str]:
    """Words, and their beginnings marked by a caret."""
    return present.union(*({"^" + w[:n] for w in present if len(w) >= n} for n in BEGINNINGS))


def swapped(present: set[str], swap: dict[str, str]) -> set[str]:
    """The word set with every identity term replaced by its group's next."""
    return {swap.get(w, w) for w in present}


def _training_words(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([sorted(words(t)) for t in b.column(2).to_pylist()], pa.list_(pa.string()))],
            ["row", "label", "words"])


def _counted(batches):
    """(feature, seen, pos) of every batch of training rows."""
    for b in batches:
        seen, pos = Counter(), Counter()
        for label, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            found = features(set(ws))
            seen.update(found)
            if label:
                pos.update(found)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[f] for f in names], pa.int64()), pa.array([pos[f] for f in names], pa.int64())],
                                         ["feature", "seen", "pos"])


def _encoded(vocabulary: list[str], swap: dict[str, str]):
    index = {w: i for i, w in enumerate(vocabulary)}

    def run(batches):
        for b in batches:
            seen, other = [], []
            for ws in b.column(2).to_pylist():
                ws = set(ws)
                seen.append(sorted(index[f] for f in features(ws) & index.keys()))
                other.append(sorted(index[f] for f in features(swapped(ws, swap)) & index.keys()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(seen, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                                             ["label", "seen", "other"])
    return run


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sums(weights: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return np.bincount(row, weights[flat], len(lists)) + weights[-1], flat, row


def _gradient(weights: np.ndarray, swap_weight: float):
    """One row a task: gradient and loss of its rows."""
    def run(batches):
        g, loss = np.zeros(len(weights)), 0.0
        for b in batches:
            y = b.column(0).to_numpy().astype(float)
            z, f, r = _sums(weights, b.column(1))
            zc, fc, rc = _sums(weights, b.column(2))
            p, pc = _sigmoid(z), _sigmoid(zc)
            d = p - pc
            push = p - y + 2 * swap_weight * d * p * (1 - p)
            push_c = -2 * swap_weight * d * pc * (1 - pc)
            for flat, row, x in ((f, r, push), (fc, rc, push_c)):
                g += np.bincount(flat, x[row], len(g))
                g[-1] += x.sum()
            loss += float(np.logaddexp(0, z).sum() - (y * z).sum() + swap_weight * (d ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([loss])], ["g", "loss"])
    return run


def _minimise(value, w: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``value(w)`` gives loss and gradient."""
    loss, g = value(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        step = 1.0
        while True:
            trial = w - step * q
            trial_loss, trial_g = value(trial)
            if trial_loss <= loss - 1e-4 * step * (g @ q) or step < 1e-4:
                break
            step *= 0.5
        done = loss - trial_loss < 1e-5 * abs(loss)
        if trial_loss < loss:
            if (trial - w) @ (trial_g - g) > 0:
                pairs = [*pairs, (trial - w, trial_g - g)][-memory:]
            w, loss, g = trial, trial_loss, trial_g
        if done:
            break
    return w


class ToxicityModel:
    """Weights of features and a bias; ``score`` scores documents."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, threshold: float = 0.7):
        self.vocabulary, self.weights, self.threshold = vocabulary, weights, threshold

    def scores(self, texts: list) -> list[float]:
        weight, bias = dict(zip(self.vocabulary, self.weights.tolist())), float(self.weights[-1])
        known = weight.keys()
        return [float(_sigmoid(bias + sum(sorted(weight[f] for f in features(words(t)) & known)))) for t in texts]

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs(doc_id, text, ...)`` to (doc_id, score, predicted), one row each."""
        def run(batches):
            for b in batches:
                s = self.scores(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= self.threshold) for x in s], pa.int32())],
                                                 ["doc_id", "score", "predicted"])
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 1 by 3; such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_GROUPS, swap_weight: float = 1.0, ridge: float = 0.1,
        max_rows: int = 20_000, max_features: int = 2_000, min_docs: int = 5, steps: int = 40) -> ToxicityModel:
    """Model of ``labels.toxic`` from ``docs`` rows that are not held out."""
    swap = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
    doc_id = F.col("doc_id").cast("long")
    picked = (labels.where("toxic is not null and doc_id is not null").where(~held_out(doc_id))
              .groupBy(doc_id.alias("row")).agg(F.min("toxic").alias("label"), F.max("toxic").alias("hi")).where("label = hi")
              .orderBy(F.xxhash64("row"), "row").limit(max_rows).select("row", F.col("label").cast("int")))
    rows = (docs.select(doc_id.alias("row"), "text").join(F.broadcast(picked), "row").where("text is not null")
            .select("row", "label", "text").mapInArrow(_training_words, "row long, label int, words array<string>"))
    rows = written(rows)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = min(max(toxic / n if n else 0.5, 1e-6), 1 - 1e-6)
        return ToxicityModel([], np.array([math.log(share / (1 - share))]))
    # association of each word with the label: z of two shares of documents
    a, b = F.col("pos") + 0.5, F.col("seen") - F.col("pos") + 0.5
    odds = F.log(a / (toxic - F.col("pos") + 0.5)) - F.log(b / (n - toxic - (F.col("seen") - F.col("pos")) + 0.5))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    counted = (rows.mapInArrow(_counted, "feature string, seen long, pos long").groupBy("feature")
               .agg(F.sum("seen").alias("seen"), F.sum("pos").alias("pos")).where(F.col("seen") >= min_docs)
               .withColumn("z", F.round(z, 6)).where(F.col("z") >= 4.0).orderBy(F.desc("z"), "feature").limit(max_features))
    vocabulary = sorted({r["feature"] for r in counted.select("feature").collect()} | set(swap))
    train = written(rows.mapInArrow(_encoded(vocabulary, swap), "label int, seen array<int>, other array<int>")
                    .repartition(max(1, min(64, n // 4000))))
    penalty = np.r_[np.full(len(vocabulary), ridge), 0.0]

    def value(w):
        parts = train.mapInArrow(_gradient(w, swap_weight), "g binary, loss double").collect()
        g = np.sum([np.frombuffer(p["g"]) for p in parts], axis=0) + penalty * w
        return math.fsum(p["loss"] for p in parts) + 0.5 * float(penalty @ w ** 2), g
    start = np.zeros(len(vocabulary) + 1)
    start[-1] = math.log(toxic / (n - toxic))
    return ToxicityModel(vocabulary, _minimise(value, start, steps))
