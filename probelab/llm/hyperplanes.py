"""Embedding near-duplicates by random-hyperplane sign hashing.

Vectors are compared only within one label. A table hashes a vector to the
signs of its products with ``bits`` random directions; pairs that agree in a
bucket of any table are verified by their exact cosine in double precision,
and the links' connected components are found on Spark.

``bits`` follows the number of vectors, so that a bucket of unrelated vectors
stays small, and ``tables`` follows from it: a pair at the threshold is
missed with probability ``miss`` at most. Equal vectors are one class first;
a class counts with its weight in n_links and needs no pairs. Buckets are
matched in blocks of at most ``BLOCK`` vectors by block pairs, so a bucket of
any size is many tasks; a pair is verified only in the first table in which
it meets.

Defined results: null, empty or zero vectors, vectors with null or non-finite
components, null labels and null ids link with nothing: n_links 0 and their
own component. Vectors of different lengths never link. Rows that repeat a
vec_id are copies that link with each other. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import components, written

THRESHOLD, MISS, SEED, BLOCK = 0.93, 1e-4, 97, 256


def tables_for(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables at which a pair at the threshold is missed with probability ``miss``."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers (rows x tables) of the rows of ``x``."""
    signs = (x @ planes(x.shape[1], bits, tables)) > 0
    return signs.reshape(len(x), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision of packed vectors of one length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)        # neither overflow nor underflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrices(raw: list[bytes], kind: str):
    """(row numbers, unit vectors) for every length of packed vectors."""
    by: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        by.setdefault(len(r), []).append(i)
    for rows in by.values():
        yield rows, _units([raw[i] for i in rows], kind)


def _usable(kind: str):
    """(vec_id, label, packed): packed vectors, null where unusable."""
    def run(batches):
        for b in batches:
            ids, labels, vectors = (b.column(i).to_pylist() for i in range(3))
            out = []
            for i, label, v in zip(ids, labels, vectors):
                packed = None
                if i is not None and label is not None and v and None not in v:
                    x = np.array(v, kind)
                    if np.isfinite(x).all() and x.any():
                        packed = x.tobytes()
                out.append(packed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "packed"])
    return run


def _buckets(kind: str, bits: int, tables: int):
    def run(batches):
        for b in batches:
            for rows, x in _matrices(b.column(2).to_pylist(), kind):
                s = signatures(x, bits, tables)
                take = pa.array(rows)
                ids, labels = b.column(0).take(take).to_numpy(), b.column(1).take(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, tables)), labels.take(pa.array(np.repeat(np.arange(len(rows)), tables))),
                     pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(s.reshape(-1)),
                     pa.array(np.full(len(rows) * tables, x.shape[1], np.int32))], ["id", "label", "table", "bucket", "dim"])
    return run


def _verified(kind: str, bits: int, tables: int, threshold: float):
    """Links of block pairs: of the vectors x of one block and y of another
    (or the same) of a bucket, those whose first common table is this one."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x, y = (_units([v["packed"] for v in r[s]], kind) for s in ("xs", "ys"))
                i, j = np.nonzero(x @ y.T >= threshold - 1e-9)
                a, c = (np.array([v["id"] for v in r[s]], np.int64) for s in ("xs", "ys"))
                keep = a[i] < c[j] if r["p"] == r["q"] else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                cosine = np.einsum("ij,ij->i", x[i], y[j])
                sx, sy = signatures(x, bits, tables), signatures(y, bits, tables)
                first = np.argmax(sx[i] == sy[j], axis=1) == r["table"]
                good = first & (cosine >= threshold)
                lo, hi = np.minimum(a[i], c[j])[good], np.maximum(a[i], c[j])[good]
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, bits: int | None = None, miss: float = MISS) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to one row per vector: vec_id,
    n_links, component_id, kept."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    element = "array<float>" if kind == "<f4" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(element).alias("v"))
    rows = written(rows.mapInArrow(_usable(kind), "vec_id long, label string, packed binary"))
    classes = written(rows.where("packed is not null").groupBy("label", "packed").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    n = classes.count()
    bits = bits or min(60, max(8, math.ceil(math.log2(max(n, 2))) - 1))
    tables = tables_for(bits, threshold, miss)
    placed = classes.select("id", "label", "packed").mapInArrow(_buckets(kind, bits, tables), "id long, label string, table int, bucket long, dim int")
    bucket = ["label", "dim", "table", "bucket"]
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    members = written(placed.join(sizes, bucket)
                      .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
                      .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n"))
    # vectors travel once per bucket block they are in; block pairs bring blocks together
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(F.col("block"), k).alias("p"), F.greatest(F.col("block"), k).alias("q")))
    spread = (members.join(classes.select("id", "label", "packed"), ["id", "label"])
              .select(*bucket, "block", F.explode(pairs).alias("pq"), F.struct("id", "packed").alias("v"))
              .groupBy(*bucket, F.col("pq.p").alias("p"), F.col("pq.q").alias("q"))
              .agg(F.collect_list(F.when(F.col("block") == F.col("pq.p"), F.col("v"))).alias("xs"),
                   F.collect_list(F.when(F.col("block") == F.col("pq.q"), F.col("v"))).alias("ys"))
              .where("size(xs) > 0 and size(ys) > 0 and (p < q or size(xs) > 1)")
              .select("table", "p", "q", "xs", "ys"))
    links = written(spread.mapInArrow(_verified(kind, bits, tables, threshold), "a long, b long"))
    weight = classes.select(F.col("id"), "weight")
    degree = (links.select("a", "b").union(links.select("b", "a")).toDF("id", "other")
              .join(weight.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("weight").alias("linked")))
    found = components(links)
    named = (classes.join(degree, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
             .select("label", "packed", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    component = F.coalesce("component", "vec_id")
    return rows.join(named, ["label", "packed"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
