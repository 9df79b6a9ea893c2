"""Exact top-k inner products from an impact-ordered index, score at a time.

Components become whole numbers w = floor(64 x). Rows are dealt by a hash of
their row number to shards of about ``SHARD`` vectors. A shard's index has, for
every dimension, its postings in the order of their value, cut into at most
``LEVELS`` segments of equal quantised value, and the whole vectors.

A query meets a shard so: in a dimension the contribution q w lies above its
least possible value by an impact >= 0, and all postings of a segment have the
impact of the segment, so in each dimension the segments fall in impact from
one end. All segments of at least a given impact are processed; a vector's
upper bound is the sum of its processed segments' impacts and, for each other
dimension, the largest impact left there. The vectors with the highest bounds
are scored exactly and give, with the best of the shards before, a score that
k rows reach. Only vectors whose bound reaches it are possible members. While
these are many, the impact is lowered and more segments are processed; once
they are few, or no segment is left, that is the proof and the search stops.
Possible members are rescored exactly, so quantising costs nothing but work.

Queries are dealt into blocks of about ``QUERIES``. A task takes a block and a
group of ``GROUP`` shards, one shard after the other, and keeps k rows a query;
the groups' rows meet in one window a query. Nothing depends on the number of
equal vectors: a shard returns k of them at most, the smallest ids.

Defined results: vectors that are null or hold null or non-finite components,
rows without an id, and vectors without components take no part. Vectors of
different lengths have no inner product. Rows that repeat an id are rows of
their own, each excludes only itself. Components and scores that no long holds
take the nearest one. An empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelab.llm.shared import scaled_vectors, written

SCALE, K, SHARD, GROUP, QUERIES, LEVELS = 64, 20, 4096, 16, 128, 64
_SAFE, _MOST = 2 ** 62, 2 ** 63 - 1


def inner(w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``w`` with ``q``, at a long's bounds
    where it holds no more."""
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top(w) * top(q) * max(len(q), 1) < _SAFE:
        return w.astype(np.int64) @ q
    exact = w.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -_MOST - 1), _MOST) for s in exact], np.int64)


class Shard:
    """Vectors ``w`` (rows x dimensions) with ids and row numbers, and their
    postings by dimension: ``order[j]`` the vectors by rising value in j,
    ``level[j]`` their segments, ``start[j]`` where each segment starts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, w: np.ndarray, levels: int = LEVELS):
        by = np.lexsort((rows, ids))
        self.ids, self.rows, self.w = ids[by], rows[by], w[by]
        self.low, self.high = self.w.min(axis=0), self.w.max(axis=0)
        span = self.high.astype(float) - self.low
        self.width = np.maximum(np.ceil((span + 1) / levels), 1)
        self.order = np.argsort(self.w, axis=0, kind="stable").T.astype(np.uint16 if len(ids) < 1 << 16 else np.int32)
        value = np.take_along_axis(self.w.T, self.order.astype(np.int64), axis=1).astype(float) - self.low[:, None].astype(float)
        self.level = np.minimum(value // self.width[:, None], levels - 1).astype(np.uint8)
        self.start = np.stack([np.searchsorted(x, np.arange(levels + 1)) for x in self.level])

    def pack(self) -> bytes:
        out, small = io.BytesIO(), np.int64
        for t in (np.int32, np.int16, np.int8):
            if np.iinfo(t).min <= self.w.min() and self.w.max() <= np.iinfo(t).max:
                small = t
        np.savez(out, **{k: v for k, v in vars(self).items() if k != "w"}, w=self.w.astype(small))
        return zstandard.compress(out.getvalue(), 3)

    @classmethod
    def unpack(cls, raw: bytes) -> Shard:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(zstandard.decompress(raw))) as z:
            vars(own).update({k: z[k] for k in z.files})
        return own.open()

    def open(self) -> Shard:
        """Ready to search: the postings of all dimensions end to end, and the
        lengths of their segments."""
        self.vectors, self.length = self.order.astype(np.int64).ravel(), np.diff(self.start, axis=1)
        return self


def bounds(shard: Shard, q: np.ndarray, least: float) -> tuple[np.ndarray, bool]:
    """Upper bounds of the scores of a shard's vectors after all segments of
    an impact of ``least`` or more, and whether these are all segments."""
    levels = shard.start.shape[1] - 1
    a, span = np.abs(q.astype(float)), shard.high.astype(float) - shard.low
    some = a > 0
    reach = np.divide(least, a, out=np.zeros_like(a), where=some)
    up = some & (q > 0)
    # rising weights: from segment ``lo`` on; falling ones: up to segment ``hi``
    lo = np.clip(np.ceil((reach + 1) / shard.width - 1), 0, levels).astype(int)
    hi = np.clip(np.floor((span - reach) / shard.width), -1, levels - 1).astype(int)
    every = np.arange(len(q))
    first = np.where(up, shard.start[every, lo], 0)
    last = np.where(up, len(shard.ids), shard.start[every, hi + 1])
    first, last = np.where(some, first, 0), np.where(some, last, 0)
    left = np.where(up, np.where(first > 0, a * np.minimum(lo * shard.width - 1, span), 0.0),
                    np.where(last < len(shard.ids), a * (span - (hi + 1) * shard.width), 0.0))
    left = np.where(some, np.maximum(left, 0.0), 0.0)
    base = float(np.where(up, q * shard.low.astype(float), np.where(some, q * shard.high.astype(float), 0.0)).sum())
    # what a vector of a processed segment has over the largest impact left in its dimension
    segment = np.arange(levels)
    rise = np.minimum((segment + 1.0) * shard.width[:, None] - 1, span[:, None])
    fall = span[:, None] - segment * shard.width[:, None]
    over = a[:, None] * np.where(up[:, None], rise, fall) - left[:, None]
    processed = some[:, None] & np.where(up[:, None], segment >= lo[:, None], segment <= hi[:, None])
    n = len(shard.ids)
    own = [shard.vectors[j * n + first[j]:j * n + last[j]] for j in np.flatnonzero(last > first)]
    upper = np.full(n, base + left.sum())
    if own:
        upper += np.bincount(np.concatenate(own), np.repeat(over.ravel(), (shard.length * processed).ravel()), n)
    return upper, bool(((last - first == n) | ~some).all())


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple:
    by = np.lexsort((rows, ids, ~scores))[:k]
    return scores[by], ids[by], rows[by]


class Search:
    """A query's best rows over shards."""

    def __init__(self, row: int, q: np.ndarray, k: int):
        self.row, self.q, self.k, self.least = row, q, k, None
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, shard: Shard, few: int | None = None) -> None:
        k, q = self.k, self.q
        few = max(4 * k, len(shard.ids) // 8) if few is None else few
        span = shard.high.astype(float) - shard.low
        slack = np.ldexp(float((np.abs(q.astype(float)) * (np.abs(shard.low.astype(float)) + np.abs(shard.high.astype(float)) + span)).sum()), -40)
        if self.least is None:
            self.least = float((np.abs(q.astype(float)) * span).mean()) / 2
        other = shard.rows != self.row
        while True:
            upper, whole = bounds(shard, q, self.least)
            top = np.argpartition(-upper, min(k, len(upper) - 1))[:k + 1]
            top = top[other[top]]
            reached = np.sort(np.concatenate([self.best[0], inner(shard.w[top], q)]))
            least = float(reached[-k]) if len(reached) >= k else -np.inf
            possible = np.flatnonzero((upper >= least - slack) & other)
            if whole or len(possible) <= few:
                break
            self.least = self.least * 0.75 if self.least >= 1 else 0.0
        own = shard.w[possible], shard.ids[possible], shard.rows[possible]
        self.best = _best(*(np.concatenate(p) for p in zip(self.best, (inner(own[0], q), own[1], own[2]))), k)


def _packed(batches):
    for b in batches:
        for rows, w in scaled_vectors(b.column(2), SCALE):
            if w.shape[1] and len(rows):
                raw, size = w.astype("<i8").tobytes(), 8 * w.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), w.shape[1], np.int32)),
                     pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())], ["row", "vec_id", "dim", "w"])


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("w").to_pylist()), "<i8").reshape(table.num_rows, -1)


def _index(key, table):
    shard = Shard(table.column("vec_id").to_numpy(), table.column("row").to_numpy(), _matrix(table))
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "postings": pa.array([shard.pack()], pa.binary())})


def _searched(k: int):
    def run(key, queries, shards):
        w = _matrix(queries) if queries.num_rows else np.zeros((0, 0), np.int64)
        found = [Search(r, q, k) for r, q in zip(queries.column("row").to_pylist(), w)]
        for raw in shards.sort_by("shard").column("postings"):
            shard = Shard.unpack(raw.as_py())
            for s in found:
                s.add(shard)
        size = [len(s.best[0]) for s in found]
        cols = [np.concatenate([s.best[i] for s in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({"row": pa.array(np.repeat(queries.column("row").to_numpy(), size)), "query_id": pa.array(np.repeat(queries.column("vec_id").to_numpy(), size)),
                         "score": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "other": pa.array(cols[2])})
    return run


def top_k(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = K, shard: int = SHARD, group: int = GROUP, block: int = QUERIES) -> DataFrame:
    """``vectors(vec_id, embedding)``: of each row that meets the condition
    ``queries`` on vec_id the k rows with the highest scores: query_id, rank,
    vec_id, score."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    rows = written(rows.mapInArrow(_packed, "row long, vec_id long, dim int, w binary"))
    asked = rows.where(queries)
    n, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n_asked // block))
    groups = -(-shards // group)
    dealt = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts))
    index = written(rows.withColumn("shard", dealt(1, shards)).groupBy("dim", "shard").applyInArrow(_index, "dim int, shard long, postings binary"))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = asked.withColumn("block", dealt(2, blocks)).withColumn("group", every(groups))
    right = index.withColumn("group", F.pmod("shard", F.lit(groups))).withColumn("block", every(blocks))
    by = ["dim", "group", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searched(k), "row long, query_id long, score long, vec_id long, other long")
    w = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
