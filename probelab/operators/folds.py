"""Fold assignment and feature orders (W3, W9) and an exact, skew-proof
row number within groups.

``row_number() OVER (PARTITION BY class ...)`` sends a whole class to one
task; a class may hold a third of all rows. ``group_row_number`` orders by a
hexadecimal hash, so its leading digits cut every group into buckets of equal
width: rows are numbered inside their bucket, and the counts of the earlier
buckets are added from a small (group, bucket) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: fold count of the reference's cross-validation.
K_FOLDS = 5
FOLD_SEED = "0"


#: Hexadecimal digits of the bucket: 65,536 buckets a group.
BUCKET_DIGITS = 4


def group_row_number(df: DataFrame, group_cols: Sequence[str], hash_key: Column, tie_col: str,
                     within: Sequence[str] = (), out: str = "rn", digits: int = BUCKET_DIGITS) -> DataFrame:
    """Exact 1-based row number within ``group_cols`` ordered by ``within``,
    then ``hash_key`` (an evenly spread hexadecimal string), then ``tie_col``.

    Bucket and number are functions of the rows alone, so the result depends
    neither on partitioning nor on which exchanges Spark reuses, and a task
    that is run again gives the same numbers. Null groups are groups."""
    bucket = [*group_cols, *within, "_b"]
    keyed = df.withColumn("_h", hash_key).withColumn("_b", F.substring("_h", 1, digits))
    stats = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group_cols).orderBy(*within, "_b").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(bucket)),
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy(*bucket).orderBy("_h", tie_col)))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(bucket)]
    return (ranked.join(stats, same).withColumn(out, F.col("_before") + F.col("_rn"))
                  .drop("_h", "_b", "_rn", "_before", *(f"_s{i}" for i in range(len(bucket)))))


def fold_order(seed: str = FOLD_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:f"), F.col("row_id").cast("string")))


def stratified_folds(labelled: DataFrame, k: int = K_FOLDS, seed: str = FOLD_SEED,
                     mode: str = "exact") -> DataFrame:
    """``(dataset, row_id, label, fold)``; every class is dealt round-robin
    over the folds continuing where the previous class stopped, so class
    shares are equal and fold sizes differ by at most one.

    ``mode='hash'`` gives ``pmod(xxhash64(seed,row_id), k)``: no sort at all,
    sizes equal only in expectation."""
    base = labelled.select("dataset", "row_id", "label")
    if mode == "hash":
        return base.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col("row_id")), F.lit(k)).cast("int"))
    ranked = group_row_number(base, ["dataset"], fold_order(seed), "row_id", within=["label"])
    return ranked.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(k)).cast("int")).drop("rn")


def feature_orders(datasets: DataFrame, qids: Sequence[str], n_perm: int = 10,
                   seed: str = FOLD_SEED) -> DataFrame:
    """``n_perm`` seeded orders of ``qids`` per dataset:
    ``(dataset, perm, k, qid)`` with k = 1..len(qids). Each order depends only
    on (seed, dataset, perm), not on which other datasets run."""
    q = F.array(*[F.lit(x) for x in qids])
    g = (datasets.select("dataset").distinct()
                 .withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
                 .withColumn("qid", F.explode(q)))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("dataset"), F.col("perm").cast("string"), F.col("qid")))
    w = Window.partitionBy("dataset", "perm").orderBy(h, "qid")
    return g.withColumn("k", F.row_number().over(w)).select("dataset", "perm", "k", "qid")
