"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct n-word shingles. Each shingle hash
picks one of ``BUCKETS`` buckets; a bucket keeps, of its smallest hash, the
leading-zero count and ``MANTISSA`` bits behind it: 16 bits a bucket whatever
the set's size. Empty buckets borrow from others by a fixed random walk, so
short texts do not collide on emptiness.

Steps, all distributed:

1. sketch and set key of every document (one scan, narrow result);
2. equal sets form a class, of which the smallest doc_id goes on;
3. bands of registers are bucket keys; within a bucket, every member is
   compared with the one that meets the most others in its buckets, its head:
   a star, linear in the bucket. The
   members not linked to the head form a star of their own, ``ROUNDS`` times;
4. a collision-corrected Jaccard estimate of the sketches settles the pairs
   that are far apart, the full shingle sets decide all others;
5. connected components of the links. What is left are pairs of members in
   different components. The triangle inequality of the Jaccard distance rules
   out a member linked to the head with one at more than twice the distance.
   Two members nearer to the head can only reach the threshold through
   shingles that the head lacks: a prefix index of these gives the pairs that
   may share enough of them, which are compared in full. Members far from every head
   meet through a prefix index: two sets of the wanted similarity share one of
   their first n - ceil(t n) + 1 shingles in any order that all sets use. The
   order is by how often a shingle's cell of 2^16 occurs among these members,
   so the few edits of their own come first and what a hot bucket shares is
   not indexed. A pair is taken only where a common shingle has enough behind it
   in both sets, which holds for the first one of every link. So no link between two documents of a
   bucket is lost, and a hot bucket is not squared.

Defined results: null or blank text has an empty set, links with nothing and
is its own component. Repeated rows with one doc_id count as copies. Null
doc_ids are kept and never linked. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.llm.shared import components, join_keys, mix64, shingle_set, texts, written

BUCKETS, MANTISSA = 128, 10
ROWS, BANDS = 5, 25
#: Standard deviations of the estimate below which a pair is left out.
SIGMAS = 5.0
#: Stars per bucket, each among the members not linked to the head before.
ROUNDS = 4
_P = BUCKETS.bit_length() - 1
_VALUE_BITS = 64 - _P
_WALK = np.stack([mix64(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(97 * step + 1))
                  % np.uint64(BUCKETS) for step in range(64)]).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a non-empty set of hashes."""
    h = np.sort(mix64(shingles))                      # bucket in the high bits, value below
    bucket = (h >> np.uint64(_VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    value = h[first] & np.uint64((1 << _VALUE_BITS) - 1)
    # leading-zero count and the bits that follow the leading one
    width = np.floor(np.log2(np.maximum(value.astype(np.float64), 1.0))).astype(np.int64)
    width -= (value < (np.uint64(1) << width.astype(np.uint64))).astype(np.int64)   # float rounding upwards
    below = value ^ (np.uint64(1) << width.astype(np.uint64))
    shift = width - MANTISSA
    part = np.where(shift >= 0, below >> np.maximum(shift, 0).astype(np.uint64),
                    below << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    zeros = np.minimum(_VALUE_BITS - 1 - width, (1 << (16 - MANTISSA)) - 1)
    reg = np.zeros(BUCKETS, np.uint16)
    reg[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | part).astype(np.uint16)
    full = np.zeros(BUCKETS, bool)
    full[bucket[first]] = True
    for step in range(len(_WALK)):
        empty = np.flatnonzero(~full)
        if not len(empty):
            return reg
        source = _WALK[step][empty]
        hit = np.isin(source, bucket[first])
        reg[empty[hit]] = reg[source[hit]]
        full[empty[hit]] = True
    reg[~full] = reg[bucket[first][0]]
    return reg


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers. Two different minima share a
    register by chance with about 1/3 x 2^-MANTISSA (equal leading-zero count,
    then equal mantissa); the share of equal registers is freed of it."""
    chance = 2.0 ** -MANTISSA / 3
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _sketches(n_words: int):
    def run(batches):
        for b in batches:
            n, key, reg = [], [], []
            for t in texts(b, "text"):
                s = shingle_set(t, n_words)
                n.append(len(s))
                if len(s):
                    x = mix64(s + np.uint64(1))
                    key.append(np.array([np.add.reduce(x), np.bitwise_xor.reduce(mix64(x)), len(s)], np.uint64).tobytes())
                    reg.append(sketch(s).tobytes())
                else:
                    key.append(None)
                    reg.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(reg, pa.binary())], ["doc_id", "n_shingles", "key", "sketch"])
    return run


def _bands(batches):
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for b in batches:
        if not b.num_rows:
            continue
        reg = np.frombuffer(b"".join(texts(b, "sketch")), np.uint16).reshape(-1, BUCKETS)
        reg = reg[:, :ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(salt, reg.shape[:2]).copy()
        for j in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + reg[:, :, j])
        ids = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], ["bucket", "id"])


def _estimates(batches):
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(texts(b, c)), np.uint16).reshape(-1, BUCKETS) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(estimate(x, y))],
                                         ["a", "b", "na", "nb", "est"])


def _sets(n_words: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shingle_set(t, n_words).tobytes() for t in texts(b, "text")], pa.binary())],
                ["id", "shingles"])
    return run


def _exact(batches):
    for b in batches:
        inter, union = [], []
        for x, y in zip(texts(b, "sa"), texts(b, "sb")):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            inter.append(both)
            union.append(len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                                         ["a", "b", "inter", "uni"])


def _with_both(pairs: DataFrame, table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``pairs(a, b)`` with columns of ``table(id, ...)`` for both ends, named by suffix."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("id").alias(side), *(F.col(c).alias(f"{short}{side}") for c, short in columns.items())), side)
    return pairs


def _deltas(batches):
    """Shingles of a star's member that its head lacks."""
    for b in batches:
        out = [np.setdiff1d(np.frombuffer(y, np.uint64), np.frombuffer(x, np.uint64), assume_unique=True).tobytes()
               for x, y in zip(texts(b, "sa"), texts(b, "sb"))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["a", "b", "shingles"])


def _cell_counts(batches):
    """How often the cells (the first 16 bits) of shingles occur in a task's sets."""
    n = np.zeros(1 << 16, np.int64)
    for b in batches:
        for raw in texts(b, "shingles"):
            n += np.bincount((np.frombuffer(raw, np.uint64) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    cell = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], ["cell", "n"])


def _prefixes(counts, threshold: int):
    """Instead of ``shingles``: their number, and the first n - ceil(threshold
    % of n) + 1 of them, rare cells first, where n is the size of the whole set."""
    def run(batches):
        of = counts.value
        for b in batches:
            size, out = [], []
            for n, raw in zip(b.column("n").to_pylist(), texts(b, "shingles")):
                s = np.frombuffer(raw, np.uint64)
                size.append(len(s))
                out.append(s[np.lexsort((s, of[(s >> np.uint64(48)).astype(np.int64)]))[:n + threshold * n // -100 + 1]].view(np.int64))
            rest = b.drop_columns(["shingles"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(size, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                                             [*rest.schema.names, "size", "prefix"])
    return run


def _prefix_index(sets: DataFrame, threshold: int) -> DataFrame:
    """``sets(..., n, shingles)`` with a row (..., n, size, at, g) for every shingle g of a prefix."""
    counts = np.zeros(1 << 16, np.int64)        # at most 65,536 numbers, whatever the input
    for cell, n in sets.select("shingles").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    rest = [c for c in sets.columns if c != "shingles"]
    schema = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in rest)
    return (sets.select(*rest, "shingles").mapInArrow(_prefixes(sets.sparkSession.sparkContext.broadcast(counts), threshold),
                                                      f"{schema}, size long, prefix array<long>")
            .select(*rest, "size", F.posexplode("prefix").alias("at", "g")))


def _far_pairs(members: DataFrame, docs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of ``members(id, fars, opens, component)`` - the buckets
    where a member is far from every head, and all its unsettled ones - in
    different components that meet in a bucket where one of them is far and
    share a shingle of their prefixes, at positions that allow a link."""
    sets = written(join_keys(docs, members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
                   .select("doc_id", "text").mapInArrow(_sets(n_words), "id long, shingles binary")
                   .withColumn("n", F.expr("cast(octet_length(shingles) / 8 as long)")))
    index = written(_prefix_index(sets, threshold).join(members, "id").select("id", "n", "fars", "opens", "component", "at", "g"))
    l, r = index.alias("l"), index.alias("r")
    # two sets share at most what follows their first common shingle
    enough = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) * (100 + threshold) >= (F.col("l.n") + F.col("r.n")) * threshold
    return (l.where("size(l.fars) > 0").join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.component") != F.col("r.component"))
                                             & enough & F.arrays_overlap("l.fars", "r.opens")
                                             & ((F.col("l.id") < F.col("r.id")) | ~F.arrays_overlap("r.fars", "l.opens")))
            .select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct())


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n_words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(zones, sets): the zone of every pair - 'link', 'mid' or 'far', farther
    apart than twice the linking distance - with na, nb and the intersection
    where it is not far; and the shingle sets of the documents looked at. The
    estimate only ever decides 'far'."""
    nearest = 2 * threshold / 100 - 1
    est = (_with_both(pairs.select("a", "b"), classes, {"n_shingles": "n", "sketch": "s"})
           .select("a", "b", "na", "nb", "sa", "sb")
           .mapInArrow(_estimates, "a long, b long, na long, nb long, est double"))
    error = SIGMAS * F.sqrt(0.25 / F.least(F.lit(BUCKETS), "na", "nb"))
    est = written(est.select("a", "b", "na", "nb", (F.col("est") + error >= nearest).alias("open")))
    ids = written(est.where("open").select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = written(join_keys(docs, ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")
                   .mapInArrow(_sets(n_words), "id long, shingles binary"))
    exact = (_with_both(est.where("open").select("a", "b"), sets, {"shingles": "s"}).select("a", "b", "sa", "sb")
             .mapInArrow(_exact, "a long, b long, inter long, uni long"))
    zone = (F.when(F.col("inter") * 100 >= F.col("uni") * threshold, "link")
            .when(F.col("inter") * 100 < F.col("uni") * (2 * threshold - 100), "far").otherwise("mid"))
    shut = est.where("not open").select("a", "b", F.lit("far"), F.lit(None).cast("long"))
    zones = exact.select("a", "b", zone.alias("zone"), "inter").union(shut)
    return written(zones.join(est.select("a", "b", "na", "nb"), ["a", "b"])), sets


def _beside(zones: DataFrame, sets: DataFrame, component: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of members of one star, at least one in the middle zone,
    that may link although in different components. Of a member only the
    intersection with the head is in the head; two members x and y share at
    most min(hx, hy) shingles within it, so what they need beyond must be
    among the shingles that the head lacks: a prefix index of these, rare ones
    first. A linked y holds ceil(t n) of x's n shingles, so at least
    ceil(t n) - hx of those that the head lacks, and one of the first
    n - ceil(t n) + 1."""
    near = (zones.where("zone <> 'far'").select(F.col("a").alias("head"), F.col("b").alias("id"), "zone", F.col("nb").alias("n"), F.col("inter").alias("h"))
            .join(component, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = (near.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.col("zone") == "mid").alias("mid"))
             .where("lo < hi and mid").select("head"))
    near = written(near.join(mixed, "head", "left_semi"))
    deltas = (_with_both(near.select(F.col("head").alias("a"), F.col("id").alias("b")), sets, {"shingles": "s"}).select("a", "b", "sa", "sb")
              .mapInArrow(_deltas, "a long, b long, shingles binary"))
    index = written(_prefix_index(written(near.join(deltas.toDF("head", "id", "shingles"), ["head", "id"])), threshold))
    apart = (F.col("l.component") != F.col("r.component")) & ((F.col("r.zone") == "link") | (F.col("l.id") < F.col("r.id")))
    need = F.lit(threshold / (100 + threshold)) * (F.col("l.n") + F.col("r.n")) - F.least("l.h", "r.h") - 1e-6
    ends = F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")
    enough = F.least(F.col("l.size") - F.col("l.at"), F.col("r.size") - F.col("r.at")) >= need
    shared = (index.alias("l").where("l.zone = 'mid'").join(index.alias("r"), (F.col("l.head") == F.col("r.head")) & (F.col("l.g") == F.col("r.g")) & apart & enough)
              .select(*ends).distinct())
    within = (near.alias("l").where("l.zone = 'mid'").join(near.alias("r"), (F.col("l.head") == F.col("r.head")) & apart & (need <= 0))
              .select(*ends))
    return shared.union(within)


def _stars(active: DataFrame) -> DataFrame:
    """``active(bucket, id)`` to (bucket, id, head) of every member but the
    heads: a bucket's head is the member that meets the most others in its
    buckets, the smallest id of equal ones. A text that a group was copied from
    shares more with each copy than they with one another, so it heads nearly
    all buckets of the group: one pair a copy, and what a copy has that the
    head lacks is its own."""
    sizes = active.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(active.join(sizes, "bucket"))
    score = met.groupBy("id").agg((-F.sum("n")).alias("least"))
    heads = met.select("bucket", "id").join(score, "id").groupBy("bucket").agg(F.min(F.struct("least", "id")).getField("id").alias("head"))
    return met.select("bucket", "id").join(heads, "bucket").where("id <> head")


def near_duplicates(docs: DataFrame, n_words: int = 5, threshold: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` to one row per document:
    doc_id, n_shingles, component_id, kept. Links are pairs with
    100 x intersection >= threshold x union of their shingle sets."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(docs.mapInArrow(_sketches(n_words), "doc_id long, n_shingles long, key binary, sketch binary"))
    classes = written(sketches.where("key is not null and doc_id is not null").groupBy("key")
                      .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    active = written(classes.select("id", "sketch").mapInArrow(_bands, "bucket long, id long"))
    stars, links = [], None
    while True:
        members = written(_stars(active.select("bucket", "id")))
        zones, sets = _compared(members.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), classes, docs, n_words, threshold)
        stars.append((zones, sets))
        found = zones.where("zone = 'link'").select("a", "b")
        links = found if links is None else links.union(found)
        if members.isEmpty():
            break
        # members that are not linked to the head go on to the next star
        active = written(members.join(zones.where("zone <> 'link'").select(F.col("a").alias("head"), F.col("b").alias("id"), "zone"), ["head", "id"])
                         .select("bucket", "id", "zone"))
        if len(stars) == rounds:
            break
    component = written(components(links)).withColumnRenamed("node", "id")
    left = None
    for zones, sets in stars:
        some = written(_beside(zones, sets, component, threshold))      # one plan a star
        left = some if left is None else left.union(some)
    if "zone" in active.columns:
        # what no star has settled: members far from every head of their bucket
        open_ = (active.groupBy("id").agg(F.collect_set(F.when(F.col("zone") == "far", F.col("bucket"))).alias("fars"), F.collect_set("bucket").alias("opens")).join(component, "id", "left")
                 .withColumn("component", F.coalesce("component", "id")))
        left = left.union(_far_pairs(written(open_), docs, n_words, threshold))
    left = written(left.distinct())
    found = component.withColumnRenamed("id", "node")
    if not left.isEmpty():
        more = _compared(left, classes, docs, n_words, threshold)[0].where("zone = 'link'").select("a", "b")
        if not more.isEmpty():
            found = written(components(links.union(more)))
    named = classes.select("key", "id").join(found.select(F.col("node").alias("id"), "component"), "id", "left") \
        .select("key", F.coalesce("component", "id").alias("component"))
    component = F.coalesce("component", "doc_id")
    return (sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
            .join(named, "key", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
