"""Helpers of the training-data operators: written intermediate tables,
size-checked joins, connected components and word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelab.session import ensure_checkpoint_dir

#: Words of every operator: runs of anything but blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one 8-byte key that may be broadcast (32 MB of keys).
BROADCAST_KEYS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Where the tables that are being written are noted: (folder, table name or null).
_NOTED: list[list[tuple[str, str | None]]] = []


@contextmanager
def noted() -> Iterator[list[tuple[str, str | None]]]:
    """The tables that ``written`` and ``bucketed`` make meanwhile, for ``discard``."""
    made: list[tuple[str, str | None]] = []
    _NOTED.append(made)
    try:
        yield made
    finally:
        _NOTED.remove(made)


def discard(spark: SparkSession, made: list[tuple[str, str | None]]) -> None:
    """Delete tables that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        folder, name = made.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: the
    lineage ends here and the files outlive any executor."""
    path = shared_dir(df.sparkSession)
    for made in _NOTED:
        made.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, on: str) -> DataFrame:
    """``df`` as a table in the shared folder, written in hash buckets of
    ``on`` without a shuffle and read as such: a join on ``on`` moves only the
    other side."""
    spark = df.sparkSession
    name, n = f"llm_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_dir(spark)
    for made in _NOTED:
        made.append((path, name))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, on).saveAsTable(name)
    return spark.table(name)


def join_keys(big: DataFrame, keys: DataFrame, on: str, how: str,
              max_rows: int = BROADCAST_KEYS) -> DataFrame:
    """Join ``big`` with a table of keys. A count that stops at ``max_rows``
    proves the bound before the keys are broadcast; beyond it both sides are
    shuffled. The result is the same."""
    if keys.limit(max_rows + 1).count() <= max_rows:
        return big.join(F.broadcast(keys), on, how)
    return big.join(keys.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row
    (node, component) per node of an edge, component = smallest node reachable.

    Alternating large-star and small-star steps, each one join on a node and
    one map-side-combined minimum, until the edges are stars. A hub with any
    number of neighbours is only ever reduced to its minimum. Self-loops and
    repeated edges do no harm; an empty table gives an empty table.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
        before = state
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.where("m < u")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low).distinct())
        e = written(small)
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased (uint64, in order)."""
    raw = (text or "").encode().lower()     # bytes.lower() touches A-Z only
    b = np.frombuffer(raw, np.uint8)
    solid = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(b)) - np.repeat(starts, np.diff(starts, append=len(b))) if starts[0] == 0 else \
        np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(starts, append=len(b)))])
    longest = int((ends - starts).max())
    value = np.where(solid, (b.astype(np.uint64) + np.uint64(1)) * _powers(longest + 1)[np.minimum(at, longest)], np.uint64(0))
    return mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted uint64 hashes. With
    fewer words the whole sequence is one; without words the set is empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = mix64(h * np.uint64(_BASE) + w[j:len(w) - n + 1 + j])
    return np.unique(h)


def texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def scaled_vectors(column: pa.Array, scale: int, offset: int = 0):
    """(row numbers, floor(scale * x) + offset as int64) for every length of
    the vectors of a list column. Null vectors and those that hold null or
    non-finite entries are left out; what no long holds takes the nearest one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)     # a null entry becomes NaN
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        with np.errstate(over="ignore", invalid="ignore"):
            x = flat[start[rows][:, None] + np.arange(n)]
            good = np.isfinite(x).all(axis=1)
            whole = np.clip(np.floor(x[good] * scale) + offset, -2.0 ** 63, 2.0 ** 63 - 1024)
        yield rows[good], whole.astype(np.int64)
