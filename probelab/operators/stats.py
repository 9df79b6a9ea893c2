"""Correlation and rank statistics (A16-A19, W4), grouped by any keys.

Input is a long table of pairs ``(*keys, x, y)`` (or values with a group
label for Mann-Whitney). Every statistic is an aggregate per key; p-values
are computed on the one-row-per-key result. Ranks come from the table of
distinct values with their counts, cut into even ranges of (key, value) and
completed by prefix sums, so that no key has to fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelab.functions.scalar import corr_p_udf, normal_p_udf
from probelab.session import cut_lineage, ship_package

TIE_DIGITS = 12


def value_ranks(counts: DataFrame, keys: Sequence[str], value: str, n: str) -> DataFrame:
    """``counts`` has a row per ``(*keys, value)`` seen ``n`` times; adds
    ``rank``, the 1-based rank of the value where ties share the mean of their
    ranks, and ``total``, the sum of ``n`` in the key. Null keys are a key.

    The ranges depend on a sample, so rows and range numbers are written once
    and both the prefix sums and the rows read what was written. A key has one
    prefix sum a range; the running sum inside a range is of one task."""
    dealt = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_sum"))
    of_key = Window.partitionBy(*keys)
    sums = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"),
                       F.sum("_sum").over(of_key).alias("total"),
                       (F.sum("_sum").over(of_key.orderBy("_part")) - F.col("_sum")).alias("_before"))
    upto = F.sum(n).over(Window.partitionBy(*keys, "_part").orderBy(value))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (dealt.withColumn("_upto", upto).join(sums, [F.col("_part") == F.col("_p"), *same])
            .withColumn("rank", F.col("_before") + F.col("_upto") - (F.col(n) - 1) / 2.0)
            .drop("_part", "_p", "_upto", "_before", *(f"_k{i}" for i in range(len(keys)))))


def _rounded(value: str) -> Column:
    """Values are compared at TIE_DIGITS decimals, so values equal up to
    summation order (accuracies averaged in a different order) count as ties."""
    return F.round(F.col(value).cast("double"), TIE_DIGITS)


def correlation(x: str, y: str) -> Column:
    """Correlation of the pairs without a null; null where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def _pairs_seen(x: str, y: str) -> Column:
    return F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, with_p: bool = True) -> DataFrame:
    """R and n (pairs without a null) per key; two-sided p from the t
    distribution. Where a side is constant r and p are null."""
    out = df.groupBy(*keys).agg(correlation(x, y).alias("r"), _pairs_seen(x, y).alias("n"))
    if with_p:
        ship_package(df.sparkSession)
    return out.withColumn("p", corr_p_udf("r", "n")) if with_p else out


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, with_p: bool = True) -> DataFrame:
    """Pearson correlation of average ranks over the pairs without a
    null (``n`` of them). Equal pairs are counted first; ranks are joined to
    distinct pairs, less the mean rank, which is (n + 1) / 2 in every key."""
    seen = F.count(F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), 1))
    pairs = (df.select(*keys, _rounded(x).alias("_x"), _rounded(y).alias("_y"))
             .groupBy(*keys, "_x", "_y").agg(seen.alias("_w")))
    ranked = pairs
    for side in ("_x", "_y"):
        counts = pairs.where("_w > 0").groupBy(*keys, side).agg(F.sum("_w").alias("_n"))
        ranks = value_ranks(counts, keys, side, "_n")
        ranks = ranks.select(*(F.col(k).alias(f"_k{i}{side}") for i, k in enumerate(keys)), F.col(side).alias(f"_v{side}"),
                             (F.col("rank") - (F.col("total") + 1) / 2.0).alias(f"_r{side}"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}{side}")) for i, k in enumerate(keys)]
        ranked = ranked.join(ranks, [F.col(side) == F.col(f"_v{side}"), F.col("_w") > 0, *same], "left")
    a, b, w = F.col("_r_x"), F.col("_r_y"), F.col("_w")
    sums = ranked.groupBy(*keys).agg(F.sum(w * a * b).alias("_ab"), F.sum(w * a * a).alias("_aa"),
                                     F.sum(w * b * b).alias("_bb"), F.sum(w).alias("n"))
    spread = F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb"))
    out = sums.select(*keys, (F.col("_ab") / F.when(spread > 0, spread)).alias("rho"), "n")
    if with_p:
        ship_package(df.sparkSession)
    return out.withColumn("p", corr_p_udf("rho", "n")) if with_p else out


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, group: str,
                 first, with_p: bool = True) -> DataFrame:
    """Two-sided Mann-Whitney U between ``group == first`` and the rest;
    normal approximation with tie correction and continuity correction.
    ``u_first`` is U of the first sample; the test uses max(U1, U2). Rows with
    a null value are left out. Where all values are equal or a sample is
    empty, z is null and p is 1. Everything is a sum over distinct values."""
    is1 = F.coalesce(F.col(group) == F.lit(first), F.lit(False))
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, _rounded(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(is1, 1)).alias("_n1")))
    t = F.col("_n").cast("double")
    s = value_ranks(counts, keys, "_v", "_n").groupBy(*keys).agg(
        F.sum("_n1").alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n2"),
        F.sum(F.col("_n1") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("_tie"))
    n = F.col("n1") + F.col("n2")
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    u2 = F.col("n1") * F.col("n2") - u1
    spread = (n + 1) - F.col("_tie") / F.when(n > 1, n * (n - 1))
    sigma = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * spread)
    z = F.when(sigma > 0, (F.greatest(u1, u2) - F.col("n1") * F.col("n2") / 2.0 - 0.5) / F.when(sigma > 0, sigma))
    out = s.select(*keys, u1.alias("u_first"), u2.alias("u_second"), z.alias("z"))
    if with_p:
        ship_package(df.sparkSession)
    return out.withColumn("p", F.when(F.col("z").isNull(), 1.0).otherwise(normal_p_udf("z"))) if with_p else out


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, grid: int = 50,
               lo: float | None = None, hi: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Least-squares line per key and its values on ``grid`` evenly
    spaced points (between ``lo``/``hi`` or the observed x range)."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    a = F.lit(lo) if lo is not None else F.col("x_min")
    b = F.lit(hi) if hi is not None else F.col("x_max")
    pts = (fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
              .withColumn("x", a + (b - a) * F.col("i") / float(grid - 1))
              .withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))
              .select(*keys, "i", "x", "y"))
    return fit, pts
