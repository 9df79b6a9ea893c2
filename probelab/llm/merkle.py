"""A Merkle manifest of a dataset by time-forward processing.

Every row is a leaf: the SHA-256 of its fields. Per group (a source) the
leaves ascend by id; every ``ARITY`` consecutive nodes become their digest
until one is left, the subroot. The subroots become one more tree, by the same
rules, and give the root.

A node's label is (last leaf below it, level), so children come before their
parent. Nodes are processed in the order of their labels; a node sends its
digest to its parent's label, and a priority queue ordered by label hands over
a parent's messages when its turn comes. The reversed sweep goes through the
labels downwards: a node sends each child the proof suffix, its siblings in
front of its own suffix.

The queue's external part is Spark's sorted, spilling shuffle: a tree is cut
into blocks of ``ARITY ** HEIGHT`` neighbours, rows are dealt by block and
sorted by label, and a block's top digest is a message, a row, for the next
tier's block. Within a block the queue is a heap. So a group of any size is
many tasks, a tier is 729 times smaller than the one below it, and no task
holds more than a block. Positions within a group come from a range sort and
the counts of its partitions.

Defined results: leaves of one group with equal ids (nulls first) go by their
digest; rows that repeat entirely are neighbours. A null group is the first
one. A lone leaf is its own subroot and a lone subroot the root; an empty
proof's digest is that of the empty text. A null id is not tampered with.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelab.llm.shared import join_keys, written

ARITY, HEIGHT = 3, 6
BLOCK = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


# ---- one block --------------------------------------------------------------

def _parent(level: int, index: int, leaves: int) -> tuple[int, int]:
    """The label of the parent of a node: (last leaf below it, level)."""
    return min((index // ARITY + 1) * ARITY ** (level + 1), leaves) - 1, level + 1


def _height(leaves: int, whole: bool) -> int:
    """Levels of a block: all of them if its group goes on above it."""
    if not whole:
        return HEIGHT
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // ARITY), h + 1
    return h


def ascend(leaves: list[str], height: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The sweep in label order: the top digest, and of each inner node, by
    label, its children's digests."""
    if not height:
        return leaves[0], {}
    queue, inner, top = [], {}, ""
    for i, d in enumerate(leaves):
        heapq.heappush(queue, (_parent(0, i, len(leaves)), i, d))
        while queue and queue[0][0][0] == i:
            label, got = queue[0][0], []
            while queue and queue[0][0] == label:
                got.append(heapq.heappop(queue)[2])
            inner[label] = got
            top = digest("".join(got))
            level, index = label[1], i // ARITY ** label[1]
            if level < height:
                heapq.heappush(queue, (_parent(level, index, len(leaves)), index, top))
    return top, inner


Path = tuple        # ((left siblings, right siblings), the rest of the path) or ()


def descend(leaves: int, height: int, inner: dict[tuple[int, int], list[str]], suffix: Path) -> Iterator[tuple[int, Path]]:
    """The reversed sweep: (leaf, its path) from the top's path ``suffix``."""
    if not height:
        yield 0, suffix
        return
    queue = [(1 - leaves, -height, suffix)]
    while queue:
        last, level, path = heapq.heappop(queue)
        last, level = -last, -level
        got, first = inner[last, level], last // ARITY ** level * ARITY
        for j in range(len(got)):
            own = (("".join(got[:j]), "".join(got[j + 1:])), path)
            if level == 1:
                yield first + j, own
            else:
                heapq.heappush(queue, (1 - min((first + j + 1) * ARITY ** (level - 1), leaves), 1 - level, own))


def _steps(path: Path) -> list[tuple[str, str]]:
    out = []
    while path:
        step, path = path
        out.append(step)
    return out


def _text(path: Path) -> str:
    return ",".join(f"{a}:{b}" for a, b in _steps(path))


def _path(text: str) -> Path:
    path = ()
    for step in reversed(text.split(",") if text else []):
        path = (tuple(step.split(":")), path)
    return path


def folded(own: str, path: Path) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for left, right in _steps(path):
        own = digest(left + own + right)
    return own


# ---- the trees on Spark -----------------------------------------------------

def _blocks(batches, columns: int):
    """(key, rows) for each run of equal (g, block) in rows sorted by them."""
    key, held = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns[:columns])):
            if r[:2] != key:
                if held:
                    yield key, held
                key, held = r[:2], []
            held.append(r)
    if held:
        yield key, held


def _tops(batches):
    """Rows (g, block, pos, total, digest) in order to the next tier's."""
    out = []
    for (g, block), rows in _blocks(batches, 5):
        total = rows[0][3]
        top, _ = ascend([r[4] for r in rows], _height(len(rows), total <= BLOCK))
        out.append((g, block, -(-total // BLOCK), top))
        if len(out) == 4096:
            yield _batch(out, _TIER)
            out = []
    yield _batch(out, _TIER)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_TIER = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])
_TIER_SQL = "g string, pos long, total long, digest string"


def _paths(batches):
    """Rows (g, block, pos, total, digest, path, ...) in order, the block's own
    path first under pos -1, to (g, pos, path) of the block's nodes."""
    out = []
    for (g, _), rows in _blocks(batches, 6):
        nodes = rows[1:]
        height = _height(len(nodes), nodes[0][3] <= BLOCK)
        for i, path in descend(len(nodes), height, ascend([r[4] for r in nodes], height)[1], _path(rows[0][5])):
            out.append((g, nodes[i][2], _text(path)))
        if len(out) >= 4096:
            yield _batch(out, _NODE)
            out = []
    yield _batch(out, _NODE)


_NODE = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.string())])


def _positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves(g, digest, ...)`` with their number ``pos`` within ``g`` in
    ``order`` and ``total``, the rows of ``g``."""
    by = ["g", *order]
    dealt = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    number = F.monotonically_increasing_id()
    ordered = written(dealt.withColumn("part", F.shiftright(number, 33)).withColumn("seq", number.bitwiseAND(F.lit((1 << 33) - 1))))
    runs = ordered.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("g")
    runs = written(runs.select(F.struct("g", "part").alias("run"), (F.sum("n").over(w.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total")))
    return join_keys(ordered.withColumn("run", F.struct("g", "part")), runs, "run", "inner", 100_000) \
        .withColumn("pos", F.col("seq") + F.col("shift")).drop("run", "part", "seq", "shift")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


@dataclass
class Tree:
    """Tiers of one forest: tiers[0] the leaves (g, pos, total, digest, ...),
    each next one the block tops of the one below; the last has one node a g."""
    tiers: list[DataFrame]

    def tops(self) -> DataFrame:
        return self.tiers[-1].select("g", "digest")

    def below(self, tier: int, paths: DataFrame, extra: list[str]) -> DataFrame:
        """Rows of a tier dealt by block, each block led by its path of
        ``paths(g, pos, path)``: a row at pos -1."""
        nodes = self.tiers[tier].withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("path", F.lit(None).cast("string"))
        lead = paths.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
        return _dealt(nodes.unionByName(lead, allowMissingColumns=True)).select("g", "block", "pos", "total", "digest", "path", *extra)

    def paths(self, tops: DataFrame) -> DataFrame:
        """From ``tops(g, path)`` the paths (g, pos, path) of tier 1's nodes."""
        paths = tops.select("g", F.lit(0).cast("long").alias("pos"), "path")
        for tier in range(len(self.tiers) - 2, 0, -1):
            paths = written(self.below(tier, paths, []).mapInArrow(_paths, "g string, pos long, path string"))
        return paths


def grow(leaves: DataFrame) -> Tree:
    """``leaves(g, pos, total, digest, ...)`` and the tiers above them."""
    tiers = [leaves]
    while True:
        nodes = tiers[-1].select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "total", "digest")
        tiers.append(written(_dealt(nodes).mapInArrow(_tops, _TIER_SQL)))
        if tiers[-1].where("total > 1").isEmpty():
            return Tree(tiers)


@dataclass
class Manifest:
    """The forest of the groups, the subroots (g, path, subroot), and the root."""
    forest: Tree
    subroots: DataFrame
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """``leaves(doc_id, g, digest, changed)``: ``g`` orders the groups,
    ``changed`` is the digest of a tampered row or null."""
    rows = written(leaves.withColumn("row", F.monotonically_increasing_id()))
    forest = grow(written(_positions(rows, ["doc_id", "digest", "row"]).drop("row")))
    tops = forest.tops().select(F.lit("").alias("g"), F.col("g").alias("member"), "digest")
    above = grow(written(_positions(tops, ["member"])))
    root = above.tops().first()
    paths = above.paths(above.tops().select("g", F.lit("").alias("path")))
    found = above.below(0, paths, ["member"]).select("g", "block", "pos", "total", "digest", "path", "member")
    return Manifest(forest, written(found.mapInArrow(_members, "g string, subroot string, path string")), root.digest if root else None)


def _members(batches):
    for _, rows in _blocks(batches, 7):
        nodes = rows[1:]
        height = _height(len(nodes), nodes[0][3] <= BLOCK)
        out = [(nodes[i][6], nodes[i][4], _text(path)) for i, path in descend(len(nodes), height, ascend([r[4] for r in nodes], height)[1], _path(rows[0][5]))]
        yield _batch(out, pa.schema([("g", pa.string()), ("subroot", pa.string()), ("path", pa.string())]))


def _led(manifest: Manifest) -> DataFrame:
    """The leaves dealt by block, each block led by its path and subroot."""
    paths = manifest.forest.paths(manifest.subroots.select("g", "path"))
    subroots = manifest.subroots.select("g", "subroot")
    paths = written(join_keys(paths, subroots, "g", "inner", 100_000))
    return manifest.forest.below(0, paths.withColumn("path", F.concat("subroot", F.lit("/"), "path")), ["doc_id", "changed"])


def _each_leaf(batches):
    """(row, subroot, path) of every leaf."""
    for _, rows in _blocks(batches, 8):
        subroot, suffix = rows[0][5].split("/")
        nodes = rows[1:]
        height = _height(len(nodes), nodes[0][3] <= BLOCK)
        for i, path in descend(len(nodes), height, ascend([r[4] for r in nodes], height)[1], _path(suffix)):
            yield nodes[i], subroot, path


def _in_batches(rows, schema, size=4096):
    out = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot and proof, the steps ``left:right`` from the
    leaf's siblings up to the root's children, comma-joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof", pa.string())])
    return _led(manifest).mapInArrow(
        lambda batches: _in_batches(((r[6], r[4], s, _text(p)) for r, s, p in _each_leaf(batches)), schema, 512),
        "doc_id long, leaf string, subroot string, proof string")


def audit(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the changed
    leaf where there is one) and verified: one row per leaf."""
    root = manifest.root
    schema = pa.schema([(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    schema = pa.schema([("doc_id", pa.int64()), *schema, ("verified", pa.bool_())])

    def run(batches):
        def rows():
            for r, subroot, path in _each_leaf(batches):
                end = folded(r[7] or r[4], path)
                yield r[6], r[4], subroot, root, digest("".join(a + b for a, b in _steps(path))), end, end == root
        return _in_batches(rows(), schema)
    return _led(manifest).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame) -> DataFrame:
    """``documents`` as leaves: groups are sources (null first, then by
    bytes); where 2 divides the crc32 of the decimal doc_id, ``changed`` is the
    digest of the row without the line feeds of its text."""
    tampered = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("g"),
                       leaf([F.col(c) for c in FIELDS]).alias("digest"),
                       F.when(hit & F.col("text").contains("\n"), leaf(tampered)).alias("changed"))


def manifest(docs: DataFrame) -> Manifest:
    return build(document_leaves(docs))
