"""Metrics on out-of-fold confusion counts (A11-A14) and on predictions.

Everything here is grouped SQL over ``(config_id, fold, label, pred, n)``;
the table is configs x folds x classes^2 at most, whatever the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_from_predictions(pred: DataFrame, keys=("config_id", "fold")) -> DataFrame:
    """Confusion counts from one prediction per row (``label``, ``pred``)."""
    return pred.groupBy(*keys, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def fold_accuracy(conf: DataFrame) -> DataFrame:
    """A14 per fold: correct / rows of the held fold."""
    return conf.groupBy("config_id", "fold").agg(
        (F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"),
        F.sum("n").alias("n"))


def cv_accuracy(conf: DataFrame) -> DataFrame:
    """Mean of the fold accuracies (not pooled) and their population std.
    They are added in the order of the folds, so that configs with equal folds
    have equal means however the rows are dealt."""
    by_fold = F.array_sort(F.collect_list(F.struct("fold", "acc")))
    total = F.aggregate(by_fold, F.lit(0.0), lambda s, f: s + f["acc"])
    return fold_accuracy(conf).groupBy("config_id").agg(
        (total / F.count("acc")).alias("acc"), F.stddev_pop("acc").alias("acc_std"),
        F.count(F.lit(1)).alias("n_folds"))


def per_class_f1(conf: DataFrame) -> DataFrame:
    """F1 of every class seen as label or prediction in a fold:
    ``2tp / (2tp + fp + fn)``."""
    tp = conf.filter(F.col("label") == F.col("pred")).groupBy("config_id", "fold", F.col("label").alias("cls")) \
             .agg(F.sum("n").alias("tp"))
    as_label = conf.groupBy("config_id", "fold", F.col("label").alias("cls")).agg(F.sum("n").alias("n_true"))
    as_pred = conf.groupBy("config_id", "fold", F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    j = (as_label.join(as_pred, ["config_id", "fold", "cls"], "full")
                 .join(tp, ["config_id", "fold", "cls"], "left")
                 .fillna(0, subset=["tp", "n_true", "n_pred"]))
    den = F.col("n_true") + F.col("n_pred")
    return j.select("config_id", "fold", "cls",
                    F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(0.0).alias("f1"))


def macro_f1(conf: DataFrame) -> DataFrame:
    """Unweighted class mean of F1 per fold, then mean over folds."""
    per_fold = per_class_f1(conf).groupBy("config_id", "fold").agg(F.avg("f1").alias("f1"))
    return per_fold.groupBy("config_id").agg(F.avg("f1").alias("f1"))


def cv_summary(conf: DataFrame) -> DataFrame:
    """acc, acc_std, macro F1 per config from one confusion table (one CV run
    serves both metrics)."""
    return cv_accuracy(conf).join(macro_f1(conf), "config_id")


def prediction_histogram(pred: DataFrame, options: DataFrame, keys=("dataset",)) -> DataFrame:
    """Predictions per option, zero-filled for options never predicted."""
    cnt = pred.groupBy(*keys, "pred").agg(F.count(F.lit(1)).alias("n"))
    return (options.join(cnt, [*keys, "pred"], "left")
                   .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint")))


def accuracy(pred: DataFrame, keys=("dataset",)) -> DataFrame:
    """A14 pooled: correct / n."""
    return pred.groupBy(*keys).agg(F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("acc"),
                                   F.count(F.lit(1)).alias("n"))


def best_candidate(scores: DataFrame, part_cols, score_col: str = "acc",
                   order_col: str = "col_idx") -> DataFrame:
    """The highest score per group; the first candidate (lowest
    ``order_col``) wins ties."""
    w = Window.partitionBy(*part_cols).orderBy(F.desc(score_col), F.col(order_col))
    return scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
