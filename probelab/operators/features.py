"""Feature store views and per-feature statistics.

The long table ``(dataset, row_id, qid, value)`` is the source of truth;
wide (one column per qid) and array (``x``, catalogue order) are views.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = ["dataset", "row_id", "qid", "value"]


def element_ids(qids: Sequence[str], width: int) -> list[str]:
    """Feature ids of ``width`` elements: the given ids, then ``element_<n>``
    (counted from 1) for those beyond them."""
    return [*qids[:width], *(f"element_{i + 1}" for i in range(len(qids), width))]


def width_of(emb: DataFrame) -> int:
    """The number of elements of the longest vector."""
    return emb.agg(F.max(F.size("embedding"))).first()[0] or 0


def embeddings_long(emb: DataFrame, qids: Sequence[str], dataset: str = "embeddings") -> DataFrame:
    """R2 on an array column: element i of ``embedding`` is the feature of
    ``qids[i]``, an element beyond them that of its ``element_<n>``."""
    names = F.array(*[F.lit(q) for q in qids])
    return (emb.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("pos", "v"))
               .select(F.lit(dataset).alias("dataset"), "row_id",
                       F.coalesce(F.try_element_at(names, F.col("pos") + 1), F.concat(F.lit("element_"), F.col("pos") + 1)).alias("qid"),
                       F.col("v").cast("double").alias("value")))


def embeddings_array(emb: DataFrame, dataset: str = "embeddings") -> DataFrame:
    """The vectors as they are: ``(dataset, row_id, x ARRAY<DOUBLE>)``."""
    return emb.select(F.lit(dataset).alias("dataset"), F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))


def embeddings_labels(emb: DataFrame, dataset: str = "embeddings") -> DataFrame:
    return emb.select(F.lit(dataset).alias("dataset"), F.col("vec_id").alias("row_id"),
                      F.col("label").cast("int").alias("label"))


def to_wide(long: DataFrame, qids: Sequence[str]) -> DataFrame:
    """Pivot with the given ids (no extra job to find them)."""
    return long.groupBy("dataset", "row_id").pivot("qid", list(qids)).agg(F.first("value"))


def wide_to_long(wide: DataFrame, qids: Sequence[str]) -> DataFrame:
    """R2: columns -> rows."""
    return wide.unpivot(["dataset", "row_id"], list(qids), "qid", "value") \
               .withColumn("value", F.col("value").cast("double"))


def to_array(long: DataFrame, qids: Sequence[str]) -> DataFrame:
    """Vector view: ``x ARRAY<DOUBLE>`` in the given qid order (null when missing)."""
    wide = to_wide(long, qids)
    return wide.select("dataset", "row_id", F.array(*[F.col(f"`{q}`").cast("double") for q in qids]).alias("x"))


def with_labels(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """Features meet their text/label rows on (dataset, row_id)."""
    return features.join(labelled, ["dataset", "row_id"])


def feature_spread(long: DataFrame) -> DataFrame:
    """A5: spread of every feature across rows (sample std)."""
    return long.groupBy("dataset", "qid").agg(F.stddev_samp("value").alias("spread"))


def spread_summary(spread: DataFrame) -> DataFrame:
    """Min / median / max of the spreads of a dataset (a sanity check
    that no question is constant across texts)."""
    return spread.groupBy("dataset").agg(F.min("spread").alias("spread_min"),
                                         F.median("spread").alias("spread_median"),
                                         F.max("spread").alias("spread_max"))


def fold_scaling(long: DataFrame, folds: DataFrame, k: int = 5, eps: float = 1e-12) -> DataFrame:
    """M1: per (dataset, held fold, qid) the mean and population std of the
    training rows (all folds but the held one). One grouped pass per
    (dataset, fold, qid) gives count/mean/M2; training statistics are the
    exact pooled combination of the other folds (no row is read k times).
    A constant column gets scale 1, so it maps to 0."""
    per = (long.join(folds.select("dataset", "row_id", "fold"), ["dataset", "row_id"])
               .groupBy("dataset", "fold", "qid")
               .agg(F.count("value").alias("n"), F.avg("value").alias("mu"),
                    (F.var_pop("value") * F.count("value")).alias("m2")))
    held = per.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
              .filter(F.col("held") != F.col("fold"))
    tot = held.groupBy("dataset", "held", "qid").agg(
        F.sum("n").alias("n_train"), (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("mean"))
    m2 = (held.join(tot, ["dataset", "held", "qid"])
              .groupBy("dataset", "held", "qid", "n_train", "mean")
              .agg(F.sum(F.col("m2") + F.col("n") * (F.col("mu") - F.col("mean")) ** 2).alias("m2")))
    std = F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n_train"))
    return m2.select("dataset", "held", "qid", "n_train", "mean", std.alias("std"),
                     F.when(std > eps * F.greatest(F.lit(1.0), F.abs(F.col("mean"))), std)
                      .otherwise(F.lit(1.0)).alias("scale"))
