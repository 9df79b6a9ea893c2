"""Conflict-constrained best-fit packing of documents into fixed sequences.

Documents are dealt by a hash to packing groups of about ``group_rows`` rows
and packed group by group, so no group grows with the input and a source or
cluster that holds a third of all rows is spread like any other. Within a
group pieces come largest first. Open bins are ordered by what is left in
them; the search starts at the smallest remainder that holds the piece and
goes on to its successors until a bin is compatible: a bin's bitmaps say
which duplicate clusters and, if ``one_per_source``, which sources it holds.

Texts longer than ``capacity`` words are cut into pieces of ``capacity``
words; full pieces are bins of their own. Documents without words take no
bin (bin null). Null sources are one source of their own. Copies of a row
are one cluster and go to different bins. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, GROUP_ROWS = 2048, 4096


class Bins:
    """Best-fit bins under conflicts."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.marks = capacity, [], []

    def put(self, size: int, marks: int) -> int:
        """The tightest compatible bin for a piece, opened if there is none."""
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order) and self.marks[self.order[at][1]] & marks:
            at += 1
        if at < len(self.order):
            left, number = self.order.pop(at)
        else:
            left, number = self.capacity, len(self.marks)
            self.marks.append(0)
        self.marks[number] |= marks
        if left > size:
            bisect.insort(self.order, (left - size, number))
        return number


def pack(pieces: list[tuple], capacity: int, one_per_source: bool) -> list[int]:
    """Bin numbers of (size, order key..., source, cluster) pieces, by size descending."""
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], *pieces[i][1]))
    bits: dict = {}
    bit = lambda kind, v: 1 << bits.setdefault((kind, v), len(bits))
    bins, out = Bins(capacity), [0] * len(pieces)
    repeated: dict = {}
    for p in pieces:
        repeated[p[3]] = repeated.get(p[3], 0) + 1
    for i in order:
        size, _, source, cluster = pieces[i]
        marks = bit("source", source) if one_per_source else 0
        if repeated[cluster] > 1:
            marks |= bit("cluster", cluster)
        out[i] = bins.put(size, marks)
    return out


def _packed(capacity: int, one_per_source: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["cluster"], r["source"] or "", r["size"]))
        pieces, meta = [], []
        for k, r in enumerate(rows):
            for start in range(0, max(r["size"], 1), capacity):
                size = min(capacity, r["size"] - start)
                meta.append((r["packing_group"], r["doc_id"], start // capacity, start, size, r["source"], r["cluster"]))
                if size:
                    pieces.append((size, (k, start), r["source"], r["cluster"] if size < capacity else (k, start)))
        numbers = iter(pack(pieces, capacity, one_per_source))
        out = [(*m[:2], next(numbers) if m[4] else None, *m[2:]) for m in meta]
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)
    return run


_NAMES = ["packing_group", "doc_id", "bin", "piece", "start_word", "n_words", "source", "cluster"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
_SCHEMA = "packing_group int, doc_id long, bin int, piece int, start_word long, n_words long, source string, cluster long"


def best_fit(docs: DataFrame, capacity: int = CAPACITY, one_per_source: bool = True, cluster: Column | None = None,
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` to one row per piece of a document:
    packing_group, doc_id, bin (within its group), piece, start_word, n_words,
    source and cluster. ``cluster`` names duplicates; by default equal texts
    are one."""
    cluster = F.xxhash64("text") if cluster is None else cluster.cast("long")
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    doc_id = F.col("doc_id").cast("long")
    rows = (docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("size"), cluster.alias("cluster"))
            .groupBy("doc_id", "source", "size", "cluster").agg(F.count("*").alias("copies"))
            .select("doc_id", "source", "size", "cluster", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    groups = max(1, -(-docs.select("doc_id").count() // group_rows))
    deal = F.pmod(F.xxhash64("doc_id", "cluster", "copy"), F.lit(groups)).cast("int")
    return rows.withColumn("packing_group", deal).groupBy("packing_group").applyInArrow(_packed(capacity, one_per_source), _SCHEMA)
