"""The analysis as one composition (lifecycle C + E) and its report tables
(M4-M8 assembled, M16, M17, J7, R3, S10).

``analyse`` runs every experiment of one feature store with the many-model
evaluator and returns tidy DataFrames; ``results_tree`` nests them per
dataset for JSON export. Chart tables (S10) are plain DataFrames - drawing
is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.operators import curves as CV
from probelab.operators import evaluate as EV
from probelab.operators import folds as FO
from probelab.operators import selection as SEL
from probelab.operators import stats as ST
from probelab.sources.catalog import CONTROL, HIGH, LOW, SENSES


def chance_table(labelled: DataFrame) -> DataFrame:
    per = labelled.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dataset").agg((F.max("n") / F.sum("n")).alias("chance"),
                                      F.countDistinct("label").alias("n_classes"), F.sum("n").alias("n"))


def analyse(long: DataFrame, labelled: DataFrame, cat: DataFrame, *, greedy: bool = True,
            n_perm: int = 10, k: int = 5) -> dict[str, DataFrame]:
    """Every experiment of the analysis over all datasets of ``long``
    (``dataset,row_id,qid,value``) with labels ``(dataset,row_id,label)``."""
    spark = long.sparkSession
    cat_rows = [r.asDict() for r in cat.orderBy("q_idx").collect()]      # design table
    qids = [r["qid"] for r in cat_rows]
    folds = FO.stratified_folds(labelled, k=k)
    prep = EV.prepare(EV.build_matrix(long, folds, qids), k)
    datasets = sorted(prep.shapes)
    kw = {"prepared": prep}
    chance = chance_table(labelled)
    out = {"chance": chance}
    out["groups"] = SEL.split_id(SEL.run_configs(None, SEL.group_configs(datasets, cat_rows), **kw),
                                 ("dataset", "grp"))
    uni = SEL.split_id(SEL.run_configs(None, SEL.univariate_configs(datasets, cat_rows), **kw),
                       ("dataset", "qid"))
    out["uni"] = uni
    out["per_sense"] = SEL.split_id(SEL.run_configs(None, SEL.sense_configs(datasets, cat_rows), **kw),
                                    ("dataset", "sense"))
    cols = SEL.columns_by_set(cat_rows)
    if greedy:
        chains = {(d, s): cols[s] for d in datasets for s in (LOW, HIGH)}
        out["curves"] = SEL.greedy_forward(None, chains, {r["q_idx"]: r["qid"] for r in cat_rows}, **kw)
    named = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    orders = FO.feature_orders(named, [r["qid"] for r in cat_rows if r["set"] == LOW],
                               n_perm=n_perm)
    band = CV.curve_band(SEL.random_order_curves(None, orders, {r["qid"]: r["q_idx"] for r in cat_rows}, **kw))
    prep.release()
    out["random_band"] = band
    out["random_gain"] = CV.gain_summary(CV.marginal_gain(band))
    meta = cat.select("qid", "set", "sense", "predicate", F.col("a_priori_metaphoricity").alias("metaphoricity"))
    per_q = (uni.join(chance.select("dataset", "chance"), "dataset").join(F.broadcast(meta), "qid")
                .withColumn("uni_acc_over_chance", F.col("acc") - F.col("chance")))
    out["per_question"] = per_q.filter(F.col("metaphoricity").isNotNull()).select(
        "dataset", "qid", "sense", "set", "predicate", "metaphoricity",
        F.col("acc").alias("uni_acc"), "uni_acc_over_chance")
    out["dataset_corr"] = (ST.pearson(out["per_question"], ["dataset"], "metaphoricity", "uni_acc_over_chance")
                           .join(ST.spearman(out["per_question"], ["dataset"], "metaphoricity",
                                             "uni_acc_over_chance").withColumnRenamed("p", "spearman_p")
                                 .drop("n"), "dataset"))
    out["control"] = per_q.filter(F.col("set") == CONTROL)
    return out


def overall(per_question: DataFrame, control: DataFrame, covariate: DataFrame | None = None) -> dict[str, DataFrame]:
    """A7 -> A16/A17 for each covariate, A8, A9, A10, A18."""
    agg = per_question.groupBy("qid", "set", "sense", "predicate", "metaphoricity") \
                      .agg(F.avg("uni_acc_over_chance").alias("utility"))
    if covariate is not None:
        agg = agg.join(F.broadcast(covariate), "qid", "left")
    covs = ["metaphoricity"] + ([c for c in covariate.columns if c != "qid"] if covariate is not None else [])
    pairs = None
    for c in covs:
        p = agg.select(F.lit(c).alias("covariate"), F.col(c).alias("x"), F.col("utility").alias("y"))
        pairs = p if pairs is None else pairs.unionByName(p)
    corr = ST.pearson(pairs, ["covariate"], "x", "y").join(
        ST.spearman(pairs, ["covariate"], "x", "y").withColumnRenamed("p", "spearman_p").drop("n"), "covariate")
    ref = control.agg(F.avg("uni_acc_over_chance").alias("control_mean"))
    sets = agg.groupBy("set").agg(F.avg("utility").alias("mean"), F.min("utility").alias("min"))
    low_min = agg.filter(F.col("set") == LOW).agg(F.min("utility").alias("low_min"))
    above = ref.unionByName(low_min, allowMissingColumns=True) \
               .agg(F.max("control_mean").alias("control_mean"), F.max("low_min").alias("low_min")) \
               .withColumn("low_all_above", F.col("low_min") > F.col("control_mean"))
    mw = ST.mann_whitney(agg.filter(F.col("set").isin(LOW, HIGH)).withColumn("t", F.lit("low_vs_high")),
                         ["t"], "utility", "set", LOW)
    fit, line = ST.linear_fit(pairs, ["covariate"], "x", "y")
    return {"utility": agg, "correlations": corr, "set_means": sets, "control": above,
            "mann_whitney": mw, "fit": fit, "fit_line": line}


def sense_matrix(per_sense: DataFrame, chance: DataFrame) -> DataFrame:
    """R3 / S10 heat-map table: accuracy over chance, one column per sense."""
    a = per_sense.join(chance.select("dataset", "chance"), "dataset")
    return a.groupBy("dataset").pivot("sense", list(SENSES)).agg(F.first(F.col("acc") - F.col("chance")))


def chart_tables(res: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The series behind the published charts."""
    return {
        "group_bars": res["groups"].join(res["chance"].select("dataset", "chance"), "dataset"),
        "curve_series": res.get("curves"),
        "sense_matrix": sense_matrix(res["per_sense"], res["chance"]),
        "random_band": res["random_band"].withColumn("lo", F.col("mean") - F.col("std"))
                                         .withColumn("hi", F.col("mean") + F.col("std")),
        "scatter_points": res["per_question"],
    }


def comparison(chance: DataFrame, zero_shot: DataFrame, trained: DataFrame) -> DataFrame:
    """Chance, zero-shot and trained accuracies per dataset in one row."""
    t = trained.groupBy("dataset").pivot("name").agg(F.first("acc"))
    return chance.select("dataset", "chance").join(zero_shot, "dataset").join(t, "dataset")


def results_tree(res: dict[str, DataFrame]) -> DataFrame:
    """S7 nesting: one row per dataset with ``groups`` and ``uni`` maps."""
    g = res["groups"].groupBy("dataset").agg(F.map_from_entries(F.collect_list(
        F.struct("grp", F.struct("acc", "acc_std", "f1", "n_folds")))).alias("groups"))
    u = res["uni"].groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("qid", "acc"))).alias("uni"))
    s = res["per_sense"].groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.struct("sense", "acc")))
                                                .alias("per_sense"))
    return res["chance"].join(g, "dataset").join(u, "dataset").join(s, "dataset")
