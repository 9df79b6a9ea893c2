"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes: words per document, per source and in all; targets by water-filling.
2. Each source is cut into blocks of about ``block_words`` words by a hash of
   doc_id, and its target into draws of blocks: as many whole epochs as fit,
   then the first blocks of a random permutation; the block at which the
   target is reached gives only documents that fit the rest.
3. The exact numbers of draws of all sources are split at the root of a
   binary tree into two halves, of each half again, down to the output
   shards. A split draws the left half without replacement: the counts follow
   the multivariate hypergeometric law, drawn source by source by inversion.
4. Each shard takes its counts from the permuted draws of each source, in
   disjoint runs, and shuffles its documents by a hash.

Everything is DataFrame expressions. Only tables of sources, blocks and
shards take part in windows; documents meet them in joins on a block, whose
size is bounded, so a hot source is many blocks.

Defined results: null text has size 0; a document of size 0 is drawn with its
block; a source without words has target 0 and is not drawn. A null source is
a source of its own, last. Repeated rows of a doc_id are drawn together. An
empty table gives no rows. Input columns are passed through whatever their
names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelab.llm.shared import WORD, join_keys, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 22
#: Passes over the block at which a target is reached.
PASSES = 4


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def _let(value: Column, body):
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.expr("cast(array() as array<bigint>)"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked items in ``drawn`` of ``total`` without
    replacement, by inversion of a uniform ``u``. Probabilities are summed
    from the mode outwards to 12 standard deviations, relative to the mode's."""
    big_n, k, n = (c.cast("double") for c in (total, marked, drawn))
    lo, hi = F.greatest(F.lit(0.0), n - (big_n - k)), F.least(n, k)
    mode = F.least(hi, F.greatest(lo, F.floor((n + 1) * (k + 1) / (big_n + 2)).cast("double")))
    sd = F.sqrt(F.greatest(F.lit(0.0), n * (k / F.greatest(big_n, F.lit(1.0))) * (1 - k / F.greatest(big_n, F.lit(1.0))) * (big_n - n) / F.greatest(big_n - 1, F.lit(1.0))))
    given = F.struct(big_n.alias("total"), k.alias("marked"), n.alias("drawn"), lo.alias("lo"), hi.alias("hi"), mode.alias("m"),
                     (F.ceil(sd * 12) + 8).cast("double").alias("reach"), u.alias("u"))

    def body(g):
        up = F.least(g["hi"] - g["m"], g["reach"]).cast("long")
        down = F.least(g["m"] - g["lo"], g["reach"]).cast("long")
        more = lambda i: (lambda x: (g["marked"] - x) * (g["drawn"] - x) / ((x + 1) * (g["total"] - g["marked"] - g["drawn"] + x + 1)))(g["m"] + i - 1)
        less = lambda i: (lambda x: x * (g["total"] - g["marked"] - g["drawn"] + x) / ((g["marked"] - x + 1) * (g["drawn"] - x + 1)))(g["m"] - i + 1)
        mass = lambda steps, ratio: F.aggregate(
            _steps(steps), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["s"] + a["w"] * ratio(i)).alias("s")))["s"]
        found = lambda steps, ratio, goal: F.aggregate(
            _steps(steps), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("at")),
            lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["s"] + a["w"] * ratio(i)).alias("s"),
                                  F.when(a["s"] < goal, i).otherwise(a["at"]).alias("at")))["at"]

        def pick(s):
            goal = g["u"] * (s["up"] + s["down"] + 1) - 1
            return (F.when(goal <= 0, g["m"])
                    .when(goal <= s["up"], g["m"] + found(up, more, goal))
                    .otherwise(g["m"] - found(down, less, goal - s["up"]))).cast("long")
        return _let(F.struct(mass(up, more).alias("up"), mass(down, less).alias("down")), pick)
    return _let(given, body)


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def split(quotas: Column, node: Column, seed: int) -> Column:
    """Left half of an array of quotas: half of all units, drawn without replacement."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    half = F.floor((total + F.pmod(F.xxhash64(F.lit(seed), node), F.lit(2))) / 2).cast("long")

    def step(a, q):
        x = hypergeometric(a["left"], q, a["draw"], _uniform(F.lit(seed), node, F.size(a["out"])))
        return _let(x, lambda v: F.struct((a["left"] - q).alias("left"), (a["draw"] - v).alias("draw"),
                                          F.concat(a["out"], F.array(v)).alias("out")))
    start = F.struct(total.alias("left"), half.alias("draw"), F.expr("cast(array() as array<bigint>)").alias("out"))
    return F.aggregate(quotas, start, step)["out"]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with rank (code point order, null last),
    weight and target. A target stops at ``most`` x its source's size; what is
    above is shared again by weight among the others until none is above: a
    source is full exactly if the level at which the water stands, with all
    sources of a lower brim full, reaches its brim."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    lower = Window.orderBy("brim", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most).withColumn("brim", F.col("cap") / F.col("weight"))
    s = s.withColumn("all", F.sum("source_size").over(total) * F.lit(float(share))).withColumn("w", F.sum("weight").over(total))
    level = (F.col("all") - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))) / (F.col("w") - F.coalesce(F.sum("weight").over(lower), F.lit(0.0)))
    s = s.withColumn("full", level >= F.col("brim"))
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(total)
    water = (F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(total), F.lit(0.0))) / rest
    return s.select("source", "source_size", "rank", "weight", F.when(F.col("full"), F.col("cap")).otherwise(water * F.col("weight")).alias("target"))


def _plan(docs: DataFrame, size, weights, share, most, block_words, shard_words, seed):
    """(sources, draws, number of shards): the written control tables of a mix."""
    base = written(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), (n_words() if size is None else size).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes, weights, share, most).withColumn("key", _source_key())
                      .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
                      .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                      .withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size")))
    keyed = join_keys(base.withColumn("key", _source_key()).drop("source"), sources.select("key", "blocks"), "key", "inner", 100_000)
    keyed = keyed.withColumn("block", block_of(seed))
    blocks = written(keyed.groupBy("key", "block").agg(F.sum("size").alias("words")))
    # the last, partial epoch
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    last = (blocks.join(sources.select("key", "epochs", "need"), "key").withColumn("end", F.sum("words").over(order))
            .where(F.col("end") - F.col("words") < F.col("need")))
    # the block at which the target is reached: documents in hash order while
    # they fit, then in the same order those that fit the rest, and so on
    cut = (keyed.join(last.where("end > need").select("key", "block", (F.col("need") - F.col("end") + F.col("words")).alias("room")), ["key", "block"])
           .withColumns(_order(seed)).groupBy("key", "block", "room", F.struct("__h", "__i").alias("o"), F.col("size").alias("each")).agg(F.sum("size").alias("size")))
    cut = written(cut.withColumns({"cuts": F.expr("cast(array() as array<struct<room:double,h:bigint,i:bigint>>)")}))
    upto = Window.partitionBy("key").orderBy("fits", "o", "each").rowsBetween(Window.unboundedPreceding, 0)
    whole_block = Window.partitionBy("key")
    for _ in range(PASSES):
        fits = cut.withColumn("fits", (F.col("each") > F.col("room")).cast("int"))
        in_time = (F.col("fits") == 0) & (F.sum("size").over(upto) <= F.col("room"))
        fits = fits.withColumn("in_time", in_time)
        # rows of one document go together
        fits = fits.withColumn("last", F.max(F.when(F.col("in_time"), F.col("o"))).over(whole_block))
        fits = fits.withColumn("went", F.sum(F.when(F.col("in_time"), F.col("size")).otherwise(0)).over(whole_block))
        added = F.when(F.col("last").isNotNull(), F.array(F.struct("room", F.col("last.__h").alias("h"), F.col("last.__i").alias("i")))).otherwise(
            F.expr("cast(array() as array<struct<room:double,h:bigint,i:bigint>>)"))
        cut = fits.withColumn("cuts", F.concat("cuts", added)).withColumn("room", F.col("room") - F.col("went")).withColumn("took", F.col("in_time")) \
            .where("not took or o = last").withColumn("size", F.when(F.col("took"), 0).otherwise(F.col("size"))).withColumn("each", F.when(F.col("took"), F.lit(1 << 62)).otherwise(F.col("each"))) \
            .select("key", "block", "room", "o", "each", "size", "cuts")
    cut = cut.groupBy("key", "block").agg(F.max("cuts").alias("cut")).where("size(cut) > 0")
    partial = (last.select("key", "block", F.col("epochs").alias("epoch"), (F.col("end") > F.col("need")).alias("part"))
               .join(cut, ["key", "block"], "left").where("not part or cut is not null"))
    whole = (blocks.join(sources.where("epochs > 0").select("key", "epochs"), "key")
             .select("key", "block", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), F.lit(False).alias("part"),
                     F.expr("cast(null as array<struct<room:double,h:bigint,i:bigint>>)").alias("cut")))
    draws = written(whole.union(partial.select("key", "block", "epoch", "part", "cut")))
    # the splitting tree
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    levels = max(0, math.ceil(math.log2(max(words, 1) / shard_words)))
    quotas = (sources.join(draws.groupBy("key").agg(F.count("*").alias("q")), "key", "left")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "key", F.coalesce("q", F.lit(0).cast("long")).alias("q")))).alias("s"))
              .select(F.lit(1).cast("long").alias("node"), F.transform("s", lambda x: x["q"]).alias("q"), F.transform("s", lambda x: x["key"]).alias("keys")))
    for level in range(levels):
        halves = _let(split(F.col("q"), F.col("node"), seed + 2 + level), lambda left: F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", left, lambda a, b: a - b).alias("q"))))
        quotas = quotas.select(F.explode(halves).alias("h"), "keys").select("h.node", "h.q", "keys")
        if level % 6 == 5:
            quotas = quotas.repartition("node")
    leaves = (quotas.select((F.col("node") - (1 << levels)).alias("shard"), F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("q").alias("q"))).alias("i", "x"))
              .select("shard", F.col("x.key").alias("key"), F.col("x.q").alias("q")).where("q > 0"))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    slots = (leaves.withColumn("end", F.sum("q").over(before))
             .select("key", "shard", F.explode(F.sequence(F.col("end") - F.col("q"), F.col("end") - 1)).alias("r")))
    permuted = Window.partitionBy("key").orderBy("epoch", F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    drawn = draws.withColumn("r", (F.row_number().over(permuted) - 1).cast("long")).join(slots, ["key", "r"])
    return sources, written(drawn.select("key", "block", "epoch", "shard", "cut")), 1 << levels


def block_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.col("blocks"))


def _order(seed: int) -> dict[str, Column]:
    """The order of documents within a block."""
    doc_id = F.col("doc_id").cast("long")
    return {"__h": F.xxhash64(F.lit(seed + 3), doc_id), "__i": F.coalesce(doc_id, F.lit(-(1 << 63)))}


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = 20_261, size: Column | None = None) -> DataFrame:
    """The mixed documents: one row (doc, shard, epoch, source_size, target)
    per document and time it is taken, ``doc`` being the whole input row,
    laid out by shard and shuffled within it. ``size`` is the size of a
    document, its words unless given."""
    sources, draws, shards = _plan(docs, size, weights, share, most, block_words, shard_words, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), _source_key().alias("key"),
                       *([] if size is None else [size.alias("__size")]))
    rows = join_keys(rows, sources.select("key", "blocks", "source_size", "target"), "key", "inner", 100_000)
    rows = rows.withColumn("block", block_of(seed)).withColumns(_order(seed))
    h, i, words = F.col("__h"), F.col("__i"), n_words("doc.text") if size is None else F.col("__size")
    within = lambda c: (words <= c["room"]) & ((h < c["h"]) | ((h == c["h"]) & (i <= c["i"])))
    inside = F.when(F.col("cut").isNull(), True).otherwise(F.exists("cut", within))
    taken = join_keys(rows, draws, ["key", "block"], "inner", 500_000).where(inside)
    shuffled = F.xxhash64(F.lit(seed + 4), "shard", "epoch", "doc_id")
    return (taken.select("doc", "shard", "epoch", "source_size", "target", shuffled.alias("place"))
            .repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "place", "doc.doc_id")
            .select("doc", "shard", "epoch", "source_size", "target"))


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's),
    taken (words the mix takes of it, repeats counted) and times."""
    narrow = written(docs.select("doc_id", "source", n_words().alias("size"), F.monotonically_increasing_id().alias("row")))
    times = (mix(narrow, weights, share, most, size=F.col("size"), **how)
             .groupBy(F.col("doc.row").alias("row")).agg(F.count("*").alias("times")))
    sources = written(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
                      .select(_source_key().alias("key"), "source_size", "target"))
    return (join_keys(narrow.withColumn("key", _source_key()), sources, "key", "inner", 100_000).join(times, "row", "left")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken"),
                    F.coalesce("times", F.lit(0)).alias("times")))
