"""Registered queries: one per operator group of the inventory.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the whole driver
tables. Computed columns carry the same names as their SQL twins in
``probelab.plans.oracle``; doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probelab.functions.text import collapse_whitespace, strip_breaks, word_count
from probelab.operators import prepare as P
from probelab.plans import inputs
from probelab.session import cut_lineage, spread
from probelab.sources.tables import read_table
from probelab.sources import catalog as C
from probelab.operators import scoring as S
from probelab.operators import features as FE
from probelab.operators import folds as FO
from probelab.operators import metrics as M
from probelab.operators import curves as CV
from probelab.operators import stats as ST
from probelab.operators import sparse as SP
from probelab.operators import tfidf as TF
from probelab.operators import zeroshot as ZS
from probelab.operators import selection as SEL
from probelab.operators import centroid as CE

#: Tasks that count the terms of one split of the documents.
TASKS_PER_SPLIT = 2
R = 6  # rounding digits of every double in a registered query


def _r(c, name):
    return F.round(c, R).alias(name)


# ---- preparation ------------------------------------------------------------

def clean_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_lang(spark, sf_dir)
    P.require_columns(raw, ["dataset", "row_id", "text"])
    out = P.clean(raw)
    return out.select("dataset", "row_id", "text", word_count(F.col("text")).cast("bigint").alias("n_words"))


def strip_breaks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    text = collapse_whitespace(strip_breaks(F.col("html")))
    return pages.select("page_id", text.alias("text"),
                        F.length(text).cast("bigint").alias("n_chars"))


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.prepared_all(spark, sf_dir).select("dataset", "row_id", "label", "label_text")


def shuffle_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (inputs.prepared_all(spark, sf_dir)
            .select("dataset", "row_id", "label", "shuffle_key")
            .orderBy("dataset", "shuffle_key"))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.raw_quality(spark, sf_dir).select("dataset", "row_id", "label", "label_text")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_distribution(inputs.described_all(spark, sf_dir))


def chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.chance(inputs.described_all(spark, sf_dir))
    return c.select("dataset", _r(F.col("chance"), "chance"))


def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.dataset_meta(inputs.described_all(spark, sf_dir))
    dist = F.transform(F.array_sort(F.map_entries("dist")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("dataset", "n", F.array_join("classes", "|").alias("classes"), "n_classes",
                    F.array_join(dist, "|").alias("dist"), _r(F.col("mean_words"), "mean_words"))



# ---- catalogue, prompts, logits ----------------------------------------------

def _cat(spark):
    return C.catalogue(spark)


def _qids(spark=None):
    return [r[1] for r in C.default_rows()]


def _texts(spark, sf_dir, keys=("dataset", "row_id")):
    """All cleaned documents, whole texts. A table of one row group is read by
    one task, so the rows are dealt by key for their questions before they are
    cleaned; the generator keeps the filters on the text from being pushed
    below the deal."""
    raw = S.spread_before_expansion(inputs.raw_lang(spark, sf_dir), len(_qids()), keys=keys)
    return P.clean(raw.withColumn("text", F.explode(F.array("text"))), None)


def _emb_long(spark, sf_dir):
    return FE.embeddings_long(read_table(spark, sf_dir, "embeddings"), _qids())


def _element_ids(spark, sf_dir):
    return FE.element_ids(_qids(), FE.width_of(read_table(spark, sf_dir, "embeddings")))


def catalog_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = C.select_qids(_cat(spark), sets=[C.LOW, C.HIGH], exclude_prefix="gib_")
    j = _emb_long(spark, sf_dir).join(F.broadcast(cat.select("qid", "set", "sense")), "qid")
    return j.groupBy("set", "sense").agg(F.count(F.lit(1)).alias("n_values"),
                                         _r(F.avg("value"), "mean_value"))


def prompts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.prompts(_texts(spark, sf_dir), _cat(spark), dealt=True)
    return p.select(*S.KEY, "prompt", F.col("prompt_len").cast("bigint").alias("prompt_len"))


def rating_prompts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 prompts joined to the features they rate (grows with the table)."""
    r = S.rating_prompts(_cat(spark)).select("qid", "prompt")
    n = _emb_long(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n_values"))
    return r.join(n, "qid").select("qid", "prompt", "n_values")


def _logits(spark, sf_dir):
    return S.answer_logits(_texts(spark, sf_dir, ["row_id"]), _cat(spark), dealt=True)


def logsumexp_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.feature_from_arrays(_logits(spark, sf_dir))
    return f.select(*S.KEY, _r(F.col("value"), "value"))


def prob_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 on the logits table in long form, over all its tokens."""
    f = S.feature_from_logits(S.long_logits(_logits(spark, sf_dir)), mode="full")
    return f.select(*S.KEY, _r(F.col("value"), "value"))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.top_tokens(S.long_logits(_logits(spark, sf_dir)), 5)
    return t.select(*S.KEY, F.col("rank").cast("bigint").alias("rank"), "token", _r(F.col("prob"), "prob"))


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 through the scorer contract (mapInArrow, budget batches)."""
    f = S.score(S.prompts(_texts(spark, sf_dir), _cat(spark), dealt=True))
    return f.select(*S.KEY, _r(F.col("value"), "value"))


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    qids = _element_ids(spark, sf_dir)
    w = FE.to_wide(_emb_long(spark, sf_dir), qids)
    return w.select("dataset", "row_id", *[_r(F.col(f"`{q}`"), q) for q in qids])


def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    qids = _element_ids(spark, sf_dir)
    emb = read_table(spark, sf_dir, "embeddings")
    wide = emb.select(F.lit("embeddings").alias("dataset"), F.col("vec_id").alias("row_id"),
                      *[F.col("embedding")[i].cast("double").alias(q) for i, q in enumerate(qids)])
    return FE.wide_to_long(wide, qids).select("dataset", "row_id", "qid", _r(F.col("value"), "value"))


def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + M12: the batch of every prompt with its size, padded length and
    share of scorer time (A20 aggregates these: ``scoring.scoring_metrics``)."""
    f = S.score(S.prompts(_texts(spark, sf_dir), _cat(spark), dealt=True))
    return f.select(*S.KEY, "batch_id", "batch_rows", "batch_maxlen", "batch_seconds")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A previous run wrote the English documents; only the rest is pending."""
    texts, cat = _texts(spark, sf_dir), _cat(spark)
    done = S.feature_from_arrays(S.answer_logits(texts.filter(F.col("label_text") == "en"), cat, dealt=True))
    return S.prompts(texts, cat, done, dealt=True).select(*S.KEY)


def feature_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = FE.feature_spread(_emb_long(spark, sf_dir))
    return s.select("dataset", "qid", _r(F.col("spread"), "spread"))


def spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = FE.spread_summary(FE.feature_spread(_emb_long(spark, sf_dir)))
    return s.select("dataset", *[_r(F.col(c), c) for c in ("spread_min", "spread_median", "spread_max")])


def _labelled_rows(spark, sf_dir):
    """Labelled rows of the two analysis datasets: embeddings (10 classes)
    and documents by language (4 classes)."""
    emb = FE.embeddings_labels(read_table(spark, sf_dir, "embeddings"))
    lang = P.index_labels(inputs.raw_lang(spark, sf_dir)).select("dataset", "row_id", "label")
    return emb.unionByName(lang)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FO.stratified_folds(_labelled_rows(spark, sf_dir))


def fold_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = FO.stratified_folds(FE.embeddings_labels(read_table(spark, sf_dir, "embeddings")))
    s = FE.fold_scaling(_emb_long(spark, sf_dir), folds)
    return s.select("dataset", F.col("held").cast("int").alias("held"), "qid", "n_train",
                    _r(F.col("mean"), "mean"), _r(F.col("std"), "std"))


def feature_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = [r[1] for r in C.default_rows() if r[5] == C.LOW]
    o = FO.feature_orders(_labelled_rows(spark, sf_dir), low)
    return o.select("dataset", "perm", F.col("k").cast("bigint").alias("k"), "qid")



# ---- predictions: metrics, curves, statistics ----------------------------------
# Out-of-fold nearest-centroid predictions on the embeddings' elements and on
# the documents' probe features: SQL can state them row by row. The logistic
# models run in the cv_* / greedy / random_order queries.

def _folded(spark, sf_dir):
    return FO.stratified_folds(_labelled_rows(spark, sf_dir))


def _matrix(spark, sf_dir):
    """Features in catalogue order, labels and folds of both datasets."""
    x = FE.embeddings_array(read_table(spark, sf_dir, "embeddings")) \
        .unionByName(S.probe_arrays(_texts(spark, sf_dir), _cat(spark)))
    return _folded(spark, sf_dir).join(x, ["dataset", "row_id"])


DATASETS = ("embeddings", "lang")


def _confusion(spark, sf_dir, configs):
    """Confusion counts of configs (key, columns), which every dataset has, or
    (key, columns, dataset); ``config_id = dataset|key``."""
    rows = [(f"{d}|{c[0]}", d, c[1]) for c in configs for d in DATASETS if len(c) < 3 or c[2] == d]
    return CE.predictions(_matrix(spark, sf_dir), rows, output="confusion")


def _qid_conf(spark, sf_dir):
    ids = _element_ids(spark, sf_dir)
    n = len(_qids())
    return _confusion(spark, sf_dir, [(q, [i]) if i < n else (q, [i], "embeddings") for i, q in enumerate(ids)])


def _low_columns():
    return {r["qid"]: r["q_idx"] for r in _cat_rows() if r["set"] == C.LOW}


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qid_conf(spark, sf_dir)


def fold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.fold_accuracy(_qid_conf(spark, sf_dir))
    return a.select("config_id", "fold", _r(F.col("acc"), "acc"), "n")


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.macro_f1(_qid_conf(spark, sf_dir))
    return f.select("config_id", _r(F.col("f1"), "f1"))


def _curves(spark, sf_dir):
    """M8: accuracy of every prefix of the random orders of the LOW features."""
    low = _low_columns()
    orders = FO.feature_orders(_labelled_rows(spark, sf_dir), list(low))
    conf = CE.predictions(_matrix(spark, sf_dir), SEL.random_order_configs(orders, low), output="confusion")
    acc = M.cv_accuracy(conf)
    parts = F.split("config_id", r"\|")
    return acc.select(parts[0].alias("dataset"), parts[1].cast("int").alias("perm"),
                      parts[2].cast("int").alias("k"), "acc")


def curve_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = CV.curve_band(_curves(spark, sf_dir))
    return b.select("dataset", "k", _r(F.col("mean"), "mean"), _r(F.col("std"), "std"), "n_orders")


def marginal_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = CV.marginal_gain(CV.curve_band(_curves(spark, sf_dir)))
    return g.select("dataset", "k", _r(F.col("mean"), "mean"), _r(F.col("gain"), "gain"))


def gain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = CV.gain_summary(CV.marginal_gain(CV.curve_band(_curves(spark, sf_dir))))
    return s.select("dataset", *[_r(F.col(c), c) for c in ("first", "last", "mean_step", "share_positive")])


def _chance_of(folded):
    per = folded.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dataset").agg((F.max("n") / F.sum("n")).alias("chance"))


def _uni(spark, sf_dir):
    """M5: per (dataset, qid) CV accuracy, chance and over-chance."""
    folded = _labelled_rows(spark, sf_dir)      # a class's rows don't depend on the folds
    acc = M.cv_accuracy(_qid_conf(spark, sf_dir))
    parts = F.split("config_id", r"\|")
    uni = acc.select(parts[0].alias("dataset"), parts[1].alias("qid"), F.col("acc").alias("uni_acc"))
    return uni.join(_chance_of(folded), "dataset").withColumn("over", F.col("uni_acc") - F.col("chance"))


def _rating(spark):
    """The covariate that the scorer gives each predicate."""
    return S.rating_features(_cat(spark)).select("qid", F.col("value").alias("llm_metaphoricity"))


def _utility(spark, sf_dir, uni=None):
    """A7 + J2 + J5: mean over-chance utility per probe joined to its covariates."""
    cat = _cat(spark).select("qid", "set", "sense", "predicate",
                             F.col("a_priori_metaphoricity").alias("metaphoricity"))
    per_q = (_uni(spark, sf_dir) if uni is None else uni).join(F.broadcast(cat), "qid").filter(F.col("metaphoricity").isNotNull())
    agg = per_q.groupBy("qid", "set", "sense", "predicate", "metaphoricity").agg(F.avg("over").alias("utility"))
    return agg.join(F.broadcast(_rating(spark)), "qid", "left")


def question_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _utility(spark, sf_dir)
    return u.select("qid", "set", "sense", "predicate", "metaphoricity", _r(F.col("utility"), "utility"),
                    _r(F.col("llm_metaphoricity"), "llm_metaphoricity"))


def set_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _utility(spark, sf_dir)
    return u.groupBy("set").agg(_r(F.avg("utility"), "mean_utility"), _r(F.min("utility"), "min_utility"))


def all_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A10: control reference (mean over-chance of the control probes over
    datasets) and whether every low probe lies above it (min > reference)."""
    uni = _uni(spark, sf_dir)
    ctrl = uni.filter(F.col("qid").startswith("gib_")) \
        .agg(F.avg("over").alias("control_mean"), F.lit(None).cast("double").alias("low_min"))
    low = _utility(spark, sf_dir, uni).filter(F.col("set") == C.LOW) \
        .agg(F.lit(None).cast("double").alias("control_mean"), F.min("utility").alias("low_min"))
    both = ctrl.unionByName(low).agg(F.max("control_mean").alias("c"), F.max("low_min").alias("m"))
    return both.select(_r(F.col("c"), "control_mean"), (F.col("m") > F.col("c")).cast("int").alias("low_all_above"))


def _pairs(spark, sf_dir):
    """Long (covariate, x, y) pairs for the statistics (one pass over the
    utility table, both covariates from it)."""
    u = _utility(spark, sf_dir)
    c = F.explode(F.array(F.struct(F.lit("a_priori").alias("covariate"), F.col("metaphoricity").alias("x")),
                          F.struct(F.lit("llm").alias("covariate"), F.col("llm_metaphoricity").alias("x"))))
    return u.select(c.alias("c"), F.col("utility").alias("y"), "set") \
            .select("c.covariate", "c.x", "y", "set")


def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ST.pearson(_pairs(spark, sf_dir), ["covariate"], "x", "y")
    return r.select("covariate", _r(F.col("r"), "r"), "n", _r(F.col("p"), "p"))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ST.spearman(_pairs(spark, sf_dir), ["covariate"], "x", "y")
    return r.select("covariate", _r(F.col("rho"), "rho"), "n", _r(F.col("p"), "p"))


def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _utility(spark, sf_dir).filter(F.col("set").isin(C.LOW, C.HIGH)).withColumn("test", F.lit("low_vs_high"))
    m = ST.mann_whitney(u, ["test"], "utility", "set", C.LOW)
    return m.select("test", _r(F.col("u_first"), "u_low"), _r(F.col("u_second"), "u_high"), _r(F.col("z"), "z"), _r(F.col("p"), "p"))


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pts = ST.linear_fit(_pairs(spark, sf_dir), ["covariate"], "x", "y")
    return pts.select("covariate", F.col("i").cast("int").alias("i"), _r(F.round("x", 12), "x"), _r(F.round("y", 12), "y"))


def sense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sense accuracy over chance, one column per sense."""
    folded = _folded(spark, sf_dir)
    senses = [(sense, [r["q_idx"] for r in _cat_rows() if r["sense"] == sense and r["set"] == C.LOW]) for sense in C.SENSES]
    acc = M.cv_accuracy(_confusion(spark, sf_dir, senses))
    parts = F.split("config_id", r"\|")
    a = acc.select(parts[0].alias("dataset"), parts[1].alias("sense"), "acc").join(_chance_of(folded), "dataset")
    m = a.groupBy("dataset").pivot("sense", list(C.SENSES)).agg(F.first(F.col("acc") - F.col("chance")))
    return m.select("dataset", *[_r(F.col(x), x) for x in C.SENSES])


def dataset_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset, covariate vs over-chance utility of the 40 probes."""
    cat = _cat(spark).select("qid", F.col("a_priori_metaphoricity").alias("x"))
    d = _uni(spark, sf_dir).join(F.broadcast(cat), "qid").filter(F.col("x").isNotNull())
    p = ST.pearson(d, ["dataset"], "x", "over").withColumnRenamed("p", "pearson_p")
    s = ST.spearman(d, ["dataset"], "x", "over").withColumnRenamed("p", "spearman_p")
    return p.join(s.drop("n"), "dataset").select("dataset", _r(F.col("r"), "pearson_r"), _r(F.col("pearson_p"), "pearson_p"),
                                                 _r(F.col("rho"), "spearman_r"), _r(F.col("spearman_p"), "spearman_p"), "n")


# ---- zero-shot ------------------------------------------------------------------

def _zs_config(spark):
    rows = [("lang", "Which language is this text written in? Choose one of: English, French, German, Spanish.",
             i, lt, disp) for i, (lt, disp) in enumerate([("en", "English"), ("fr", "French"),
                                                           ("de", "German"), ("es", "Spanish")])]
    return spark.createDataFrame(rows, ZS.ZS_SCHEMA)


def _zs_pred(spark, sf_dir):
    cfg = _zs_config(spark)
    return ZS.predict(ZS.option_scores(_texts(spark, sf_dir), cfg), cfg)


def zero_shot_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _zs_pred(spark, sf_dir)


def zero_shot_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ZS.histogram(_zs_pred(spark, sf_dir), _zs_config(spark))


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance, zero-shot accuracy (where the dataset has options) and group
    accuracies per dataset."""
    folded = _folded(spark, sf_dir)
    zs = M.accuracy(_zs_pred(spark, sf_dir)).select("dataset", F.col("acc").alias("zero_shot"))
    cols = SEL.columns_by_set(_cat_rows())
    acc = M.cv_accuracy(_confusion(spark, sf_dir, [(g, cols[g]) for g in (C.LOW, "SYN_ALL")]))
    parts = F.split("config_id", r"\|")
    g = acc.select(parts[0].alias("dataset"), parts[1].alias("grp"), "acc") \
           .groupBy("dataset").pivot("grp", [C.LOW, "SYN_ALL"]).agg(F.first("acc"))
    out = _chance_of(folded).join(zs, "dataset", "left").join(g, "dataset")
    return out.select("dataset", _r(F.col("chance"), "chance"), _r(F.col("zero_shot"), "zero_shot"),
                      _r(F.col(C.LOW), "low_acc"), _r(F.col("SYN_ALL"), "all_acc"))


# ---- TF-IDF -------------------------------------------------------------------------

def _tfidf_texts(spark, sf_dir):
    """Texts dealt by key before they are cleaned, more tasks for more input;
    a join by key keeps the deal."""
    raw = inputs.raw_lang(spark, sf_dir)
    return P.clean(spread(raw, "row_id", least=TASKS_PER_SPLIT * raw.rdd.getNumPartitions()), None)


def _tfidf_docs(spark, sf_dir):
    folds = FO.stratified_folds(P.index_labels(inputs.raw_lang(spark, sf_dir)))
    return _tfidf_texts(spark, sf_dir).join(folds.select("dataset", "row_id", "fold"), ["dataset", "row_id"])


def _tfidf_labelled(spark, sf_dir):
    """The documents of ``_tfidf_docs``, each with all ``labels`` of its key.
    The keys' side is hashed, so that no text is sorted."""
    folds = FO.stratified_folds(P.index_labels(inputs.raw_lang(spark, sf_dir)))
    keys = folds.groupBy("dataset", "row_id").agg(F.collect_list("fold").alias("folds"), F.collect_list("label").alias("labels"))
    return (_tfidf_texts(spark, sf_dir).join(keys.hint("shuffle_hash"), ["dataset", "row_id"])
            .withColumn("fold", F.explode("folds")).drop("folds"))


def _tfidf_vocab(spark, sf_dir, docs):
    return TF.vocabulary(TF.term_counts(docs), docs.select("dataset", "row_id", "fold"))


def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _tfidf_vocab(spark, sf_dir, _tfidf_docs(spark, sf_dir))
    return v.select("dataset", F.col("held").cast("int").alias("held"), "term", "tf", "df",
                    F.col("rank").cast("bigint").alias("rank"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a kept term is a zero vector."""
    docs = _tfidf_docs(spark, sf_dir)
    v = TF.vectors(docs, _tfidf_vocab(spark, sf_dir, docs))
    total = lambda f: F.aggregate("vals", F.lit(0.0), lambda acc, w: acc + f(w))
    sums = v.select("dataset", "held", "row_id", "norm", F.size("vals").cast("bigint").alias("n"),
                    total(lambda w: w).alias("s"), total(lambda w: w * w).alias("ss"))
    sums = sums.withColumn("_j", TF.joint_norm())
    over = lambda c: F.sum(c).over(Window.partitionBy("dataset", "held", "row_id"))
    return sums.select("dataset", "held", "row_id", over("n").alias("n_terms"), _r(over(F.col("s") * F.col("_j")), "weight_sum"),
                       _r(over(F.col("ss") * F.col("_j") * F.col("_j")), "norm2"))


def tfidf_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = TF.coded(_tfidf_labelled(spark, sf_dir), "labels")
    pred = SP.predictions(*TF.blocks(codes, TF.frequent_vocabulary(codes)))
    conf = M.confusion_from_predictions(pred.withColumn("config_id", F.concat_ws("|", "dataset", F.lit("TFIDF")))
                                            .withColumnRenamed("held", "fold"))
    return M.cv_summary(cut_lineage(conf))      # a few counts, read for each metric


# ---- model-based cross-validation (no SQL twin) ------------------------------------

def _cat_rows():
    names = ["q_idx", "qid", "sense", "predicate", "question", "set", "a_priori_metaphoricity"]
    return [dict(zip(names, r)) for r in C.default_rows()]


def _emb_matrix(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    folds = FO.stratified_folds(FE.embeddings_labels(emb))
    return folds.join(FE.embeddings_array(emb), ["dataset", "row_id"])


def cv_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: LOW, HIGH, ALL, control groups - acc, std, macro F1."""
    res = SEL.run_configs(_emb_matrix(spark, sf_dir), SEL.group_configs(["embeddings"], _cat_rows()))
    return SEL.split_id(res, ("dataset", "grp"))


def cv_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: one logistic model per probe."""
    res = SEL.run_configs(_emb_matrix(spark, sf_dir), SEL.univariate_configs(["embeddings"], _cat_rows()))
    return SEL.split_id(res, ("dataset", "qid"))


def cv_sense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the four low probes of each sense."""
    res = SEL.run_configs(_emb_matrix(spark, sf_dir), SEL.sense_configs(["embeddings"], _cat_rows()))
    return SEL.split_id(res, ("dataset", "sense"))


def greedy_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: full greedy forward paths of the LOW and HIGH sets."""
    rows = _cat_rows()
    cols = SEL.columns_by_set(rows)
    chains = {("embeddings", C.LOW): cols[C.LOW], ("embeddings", C.HIGH): cols[C.HIGH]}
    return SEL.greedy_forward(_emb_matrix(spark, sf_dir), chains, {r["q_idx"]: r["qid"] for r in rows})


def random_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: 10 random orders x 20 prefixes of the LOW set, then A15."""
    rows = _cat_rows()
    low = [r["qid"] for r in rows if r["set"] == C.LOW]
    m = _emb_matrix(spark, sf_dir)
    orders = FO.feature_orders(m.select("dataset").distinct(), low)
    curves = SEL.random_order_curves(m, orders, {r["qid"]: r["q_idx"] for r in rows})
    return CV.curve_band(curves)


def mlp_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + M15: logistic and perceptron on LOW and ALL, side by side."""
    from probelab.operators import evaluate as EV
    m = _emb_matrix(spark, sf_dir)
    cfg = [c for c in SEL.group_configs(["embeddings"], _cat_rows(), groups=(C.LOW, "SYN_ALL"))]
    prep = EV.prepare(m)
    lr = EV.evaluate_many(None, EV.config_frame(spark, cfg), output="acc", prepared=prep).withColumn("model", F.lit("lr"))
    mlp = (EV.evaluate_many(None, EV.config_frame(spark, cfg), classifier="mlp", output="acc", prepared=prep)
           .withColumn("model", F.lit("mlp")))
    prep.release()
    return SEL.split_id(lr.unionByName(mlp), ("dataset", "grp"))


REGISTRY = {
    "clean_truncate": clean_truncate,
    "strip_breaks": strip_breaks_q,
    "balanced_sample": balanced_sample,
    "shuffle_key": shuffle_key,
    "label_names": label_names,
    "class_distribution": class_distribution,
    "chance": chance,
    "dataset_meta": dataset_meta,
    "catalog_sets": catalog_sets,
    "prompts": prompts_q,
    "rating_prompts": rating_prompts_q,
    "logsumexp_diff": logsumexp_diff,
    "prob_diff": prob_diff,
    "top_tokens": top_tokens,
    "features_long": features_long,
    "features_wide": features_wide,
    "unpivot": unpivot,
    "batch_plan": batch_plan,
    "resume_antijoin": resume_antijoin,
    "feature_spread": feature_spread,
    "spread_summary": spread_summary,
    "stratified_folds": stratified_folds,
    "fold_scaling": fold_scaling,
    "feature_orders": feature_orders,
    "confusion": confusion,
    "fold_accuracy": fold_accuracy,
    "macro_f1": macro_f1,
    "curve_band": curve_band,
    "marginal_gain": marginal_gain,
    "gain_summary": gain_summary,
    "question_utility": question_utility,
    "set_means": set_means,
    "all_above": all_above,
    "pearson": pearson,
    "spearman": spearman,
    "mann_whitney": mann_whitney,
    "linear_fit": linear_fit,
    "sense_matrix": sense_matrix,
    "dataset_correlations": dataset_correlations,
    "zero_shot_pred": zero_shot_pred,
    "zero_shot_hist": zero_shot_hist,
    "comparison": comparison,
    "tfidf_vocab": tfidf_vocab,
    "tfidf_weights": tfidf_weights,
    "tfidf_cv": tfidf_cv,
    "cv_groups": cv_groups,
    "cv_univariate": cv_univariate,
    "cv_sense": cv_sense,
    "greedy_forward": greedy_forward,
    "random_order": random_order,
    "mlp_check": mlp_check,
}
