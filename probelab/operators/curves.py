"""Curve summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def curve_band(curves: DataFrame) -> DataFrame:
    """Mean and population std over orders, per (dataset, k)."""
    return curves.groupBy("dataset", "k").agg(F.avg("acc").alias("mean"),
                                              F.stddev_pop("acc").alias("std"),
                                              F.count(F.lit(1)).alias("n_orders"))


def marginal_gain(band: DataFrame) -> DataFrame:
    """Difference of consecutive points of the mean curve."""
    w = Window.partitionBy("dataset").orderBy("k")
    return band.withColumn("gain", F.col("mean") - F.lag("mean").over(w))


def gain_summary(gains: DataFrame) -> DataFrame:
    """First and last point, mean step and share of positive steps."""
    return gains.groupBy("dataset").agg(
        F.min_by("mean", "k").alias("first"), F.max_by("mean", "k").alias("last"),
        F.avg("gain").alias("mean_step"),
        F.avg(F.when(F.col("gain").isNotNull(), (F.round("gain", 12) > 0).cast("double"))).alias("share_positive"))


def curve_lists(band: DataFrame) -> DataFrame:
    """``k``, ``mean``, ``std`` as lists ordered by k (for JSON export)."""
    s = F.sort_array(F.collect_list(F.struct("k", "mean", "std")))
    return band.groupBy("dataset").agg(s.alias("pts")).select(
        "dataset", F.transform("pts", lambda p: p["k"]).alias("k"),
        F.transform("pts", lambda p: p["mean"]).alias("mean"),
        F.transform("pts", lambda p: p["std"]).alias("std"))
