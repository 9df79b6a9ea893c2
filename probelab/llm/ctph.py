"""Context-triggered piecewise hashing of whole documents.

A rolling hash over ``WINDOW`` bytes marks chunk ends where its value hits a
residue of the block size; each chunk gives one character of the signature
from a hash of its bytes. The block size is the power of two that leaves
about ``LENGTH`` chunks, and a fingerprint holds the signatures at that size
and at twice it: ``size:signature:signature2``. Two fingerprints are compared
where they share a block size, by the edit distance of the signatures
(insertions and deletions), after a test for a common run of characters that
unrelated texts do not show.

Each document is also compared with an edited form of itself, made from the
next document in doc_id order. Documents are dealt to ranges of doc_id of
bounded size; each range also gets a copy of the first document behind it, so
neighbours meet in one task without a global sort.

Null text counts as empty; the fingerprint of an empty text is ``4::``. With
one row the next document is the row itself. Rows with equal doc_id follow
each other in the order of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import mix64

WINDOW, LENGTH, SMALLEST, RUN = 7, 64, 4, 7
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_ROLL = [pow(0x2545F4914F6CDD1D, j, 1 << 64) for j in range(WINDOW)]
_R = 0xD6E8FEB86659FD93
_R_INVERSE = pow(_R, -1, 1 << 64)
_STEP = 1 << 20


def _geometric(ratio: int, n: int) -> np.ndarray:
    p = np.full(n, ratio, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_TABLE = {r: _geometric(r, _STEP) for r in (_R, _R_INVERSE)}


def _chunk_hashes(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the chunks that end before ``ends`` (ascending,
    the last at most len(b)); texts of any length go in steps of 1 MB."""
    total, value, at = 0, [], 0
    sums = np.empty(len(ends), np.uint64)
    for lo in range(0, max(int(ends[-1]), 1), _STEP):
        part = b[lo:lo + _STEP].astype(np.uint64) + np.uint64(1)
        scale = np.uint64(pow(_R, lo, 1 << 64))
        acc = np.cumsum(part * _TABLE[_R][:len(part)] * scale, dtype=np.uint64) + np.uint64(total)
        hi = np.searchsorted(ends, lo + len(part), "right")
        sums[at:hi] = acc[ends[at:hi] - 1 - lo]
        total, at = int(acc[-1]), hi
    starts = np.concatenate([[0], ends[:-1]])
    inverse = _TABLE[_R_INVERSE][starts % _STEP]
    far = starts // _STEP
    if far.any():
        step = _geometric(pow(_R_INVERSE, _STEP, 1 << 64), int(far.max()) + 1)
        inverse = inverse * step[far]
    return mix64(np.diff(sums, prepend=np.uint64(0)) * inverse + (ends - starts).astype(np.uint64))


def _signature(b: np.ndarray, ends: np.ndarray) -> str:
    """One character a chunk; the rest behind the last mark is a chunk too."""
    if not len(b):
        return ""
    if not len(ends) or ends[-1] != len(b):
        ends = np.append(ends, len(b))
    c = (_chunk_hashes(b, ends) >> np.uint64(58)).astype(np.int64)
    # a run of one character says no more than three of it
    run = np.zeros(len(c), bool)
    run[3:] = (c[3:] == c[2:-1]) & (c[3:] == c[1:-2]) & (c[3:] == c[:-3])
    return _ALPHABET[c[~run]].tobytes().decode()


def fingerprint(text: str) -> str:
    b = np.frombuffer(text.encode(), np.uint8)
    if not len(b):
        return f"{SMALLEST}::"
    roll = np.zeros(len(b), np.uint64)
    wide = b.astype(np.uint64) + np.uint64(1)
    for j in range(min(WINDOW, len(b))):
        roll[j:] += wide[:len(b) - j] * np.uint64(_ROLL[j])
    roll = mix64(roll)
    marks = np.flatnonzero((roll & np.uint64(SMALLEST - 1)) == np.uint64(SMALLEST - 1))
    level = roll[marks]
    size = SMALLEST
    while size * LENGTH < len(b):
        size *= 2
    ends = lambda s: marks[(level & np.uint64(s - 1)) == np.uint64(s - 1)] + 1
    while size < len(b) and len(ends(size)) > 2 * LENGTH:
        size *= 2
    while size > SMALLEST and len(ends(size)) < LENGTH // 2:
        size //= 2
    return f"{size}:{_signature(b, ends(size))}:{_signature(b, ends(2 * size))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, max(3, min(len(a), len(b)) // 3))        # short texts have short runs
    if {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: similarity of two fingerprints at compatible block sizes;
    1 for equal ones, 0 where the sizes are more than a factor of two apart."""
    if x == y:
        return 1.0
    (sx, x1, x2), (sy, y1, y2) = x.split(":"), y.split(":")
    sx, sy = int(sx), int(sy)
    if sx == sy:
        return max(_alike(x1, y1), _alike(x2, y2) if min(len(x2), len(y2)) >= RUN else 0.0)
    if sx == 2 * sy:
        return _alike(x1, y2)
    if sy == 2 * sx:
        return _alike(x2, y1)
    return 0.0


def edited(text: str, after: str) -> str:
    """``text`` whose last half of code points is replaced by the first as
    many (or all) of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def _rows(batches):
    """Neighbours of one range, in order; the last row of a range is only a neighbour."""
    held = None
    for b in batches:
        out = []
        for part, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            text = text or ""
            mark = fingerprint(text)
            if held and held[0] == part:
                _, key, t, f = held
                e = edited(t, text)
                g = fingerprint(e)
                out.append((key, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, likeness(f, g), likeness(f, mark)))
            held = (part, doc_id, text, mark)
        cols = list(zip(*out)) if out else [[]] * 7
        types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], _OUT)


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
#: Rows of a doc_id range at which tasks aim, and the most ranges; rows stream
#: through a task, so a range may be larger.
RANGE_ROWS, MOST_RANGES = 4096, 20_000


def _range_of(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(edges, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "right")
        return pd.Series(np.where(ids.isna(), 0, found)).astype("int32")
    return range_of(F.col("doc_id"))


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` to one row per document:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null doc_id comes before all others."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    parts = max(1, min(MOST_RANGES, -(-n // range_rows)))
    bounds = docs.select(F.col("doc_id").cast("double").alias("i")).approxQuantile(
        "i", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in bounds})
    dealt = docs.withColumn("part", _range_of(bounds) if bounds else F.lit(0))
    # the first document of each range, needed behind the range before it
    first_ids = dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()
    if not first_ids:
        return spark.createDataFrame([], _SCHEMA)
    numbers = sorted(r["part"] for r in first_ids)
    before = dict(zip(numbers, numbers[-1:] + numbers[:-1]))
    firsts = spark.createDataFrame([(before[r["part"]], None if r["nulls"] else r["doc_id"]) for r in first_ids], "part int, first long")
    tail = (docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first")))
            .groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", "doc_id", "text", F.lit(1).alias("tail")))
    rows = dealt.select("part", "doc_id", "text", F.lit(0).alias("tail")).union(tail)
    return (rows.repartition(parts, "part").sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")
            .select("part", "doc_id", "text").mapInArrow(_rows, _SCHEMA))
