"""Probe scoring job.

texts (spread by the expansion factor, a shuffle of the small side only) x
questions (a generator over the size-checked catalogue, no join) -> prompt
-> sort by length within each partition -> ``mapInArrow``: token-budget
batches as zero-copy slices -> scorer -> feature.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelab.functions.lexical import LexicalScorer, characters, log_counts, logit_arrays, question_weights
from probelab.functions.logits import (NO_WORDS, YES_WORDS, logit_diff, lse_array,
                                       np_lse, prob_diff_from_lse, variant_rows)
from probelab.functions.prompts import length_proxy, rating_prompt, yes_no_prompt
from probelab.functions.text import space_count
from probelab.sources.catalog import local_list

KEY = ["dataset", "row_id", "qid"]
# Fixed value: padded tokens per batch (rows x longest prompt).
TOKEN_BUDGET = 24000


def prompts(texts: DataFrame, cat: DataFrame, done: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """J1 + F5: every text with every question. The catalogue is a design
    table (size-checked on the driver), so the product is a map-side
    generator: no join, no shuffle.

    S9: ``done(dataset, row_id, qid)`` leaves out what is answered. A row's
    answered questions, at most as many as were ever asked, are a set that
    the generator reads, so keys and texts are joined, never prompts.
    ``dealt``: the rows went through ``spread_before_expansion`` before."""
    qs = local_list(cat)
    if done is not None:
        answered = (done.select(F.col("dataset").cast("string").alias("_d"), F.col("row_id").alias("_i"), "qid")
                    .groupBy("_d", "_i").agg(F.collect_set("qid").alias("_done")))
        texts = (texts.join(answered, (F.col("dataset") == F.col("_d")) & (F.col("row_id") == F.col("_i")), "left")
                 .where(F.coalesce(~F.forall(F.array(*[F.lit(q["qid"]) for q in qs]),
                                             lambda q: F.array_contains("_done", q)), F.lit(True))))
    texts = texts if dealt else spread_before_expansion(texts, len(qs))
    # pieces of the prompt = spaces + 1; the text's spaces are counted once
    # per text, below the generator, the template's once per question (no per-prompt scan)
    texts = texts.select("dataset", "row_id", "text", space_count(F.col("text")).alias("_sp"), *(["_done"] if done is not None else []))
    arr = F.array(*[F.struct(F.lit(q["qid"]).alias("qid"), F.lit(q["question"]).alias("question"),
                             F.lit(template_spaces(q["question"])).alias("sp")) for q in qs])
    if done is not None:
        arr = F.filter(arr, lambda q: ~F.coalesce(F.array_contains("_done", q["qid"]), F.lit(False)))
    return (texts.select("dataset", "row_id", "text", "_sp", F.explode(arr).alias("q"))
                 .select("dataset", "row_id", F.col("q.qid").alias("qid"),
                         yes_no_prompt(F.col("text"), F.col("q.question")).alias("prompt"),
                         (F.col("_sp") + F.col("q.sp") + 1).alias("prompt_len")))


def spread_before_expansion(texts: DataFrame, factor: int, per_part: int = 8,
                            keys: Sequence[str] = ("dataset", "row_id")) -> DataFrame:
    """Every text becomes ``factor`` prompts inside its partition; spread the
    (small) text side first so prompt partitions keep a workable size:
    partitions x ceil(factor / per_part), hashed on the unique row key (no
    skew possible, deterministic on retry). With ``keys`` of row_id alone, what
    is grouped by ``KEY`` afterwards lies together even where the dataset is a
    literal, which an exchange's keys keep and a group's keys lose."""
    spark = texts.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if texts.isStreaming:
        return texts.repartition(base, *keys)
    n_in = texts.rdd.getNumPartitions()
    n = max(base, n_in * -(-factor // per_part))
    return texts.repartition(n, *keys)


def template_spaces(question: str) -> int:
    """Spaces the yes/no template adds around a text for one question."""
    from probelab.functions.prompts import ANSWER_YES_NO
    return ("\n\nQuestion: " + question + ANSWER_YES_NO).count(" ")


def rating_prompts(cat: DataFrame) -> DataFrame:
    """one prompt per predicate, no text side."""
    p = cat.select(F.lit("rating").alias("dataset"), F.lit(-1).cast("bigint").alias("row_id"),
                   "qid", rating_prompt(F.col("predicate")).alias("prompt"))
    return p.withColumn("prompt_len", length_proxy(F.col("prompt")))


# ---- logits tables (long form) -------------------------------------------------

ANSWERS = {"yes": YES_WORDS, "no": NO_WORDS}


def answer_logits(texts: DataFrame, cat: DataFrame, answers: dict[str, Sequence[str]] | None = None,
                  dealt: bool = False) -> DataFrame:
    """J1 + F9 in array form: for every text and question the logits of each
    answer's variants, ``(dataset, row_id, qid, <answer> ARRAY<DOUBLE>, ...)``.
    Characters are counted once per text; the questions are a generator over
    the size-checked catalogue: no join, no shuffle of prompts. ``dealt``: as
    in ``prompts``."""
    answers = answers or ANSWERS
    variants = variant_rows(answers)
    chars = characters([t for _, t, _ in variants])
    qs = local_list(cat)
    design = [{"qid": q["qid"], "w": question_weights(q["question"], chars)} for q in qs]
    arr = F.from_json(F.lit(json.dumps(design)), "array<struct<qid: string, w: array<int>>>")       # one literal, folded while planning
    counted = texts.select("dataset", "row_id", log_counts("text", chars).alias("logs"))
    rows = (counted if dealt else spread_before_expansion(counted, len(qs))) \
        .select("dataset", "row_id", "logs", F.explode(arr).alias("q"))
    own = logit_arrays(variants, list(answers), chars, "q.w", "logs")
    return rows.select("dataset", "row_id", F.col("q.qid").alias("qid"), *(F.expr(c).alias(a) for a, c in zip(answers, own)))


def long_logits(logits: DataFrame, answers: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The logits table in long form ``(dataset,row_id,qid,answer,token,logit)``."""
    answers = answers or ANSWERS
    variants = variant_rows(answers)
    each = [F.struct(F.lit(a).alias("answer"), F.lit(t).alias("token"), F.element_at(a, [x for x in variants if x[0] == a].index((a, t, n)) + 1).alias("logit"))
            for a, t, n in variants]
    return logits.select(*KEY, F.explode(F.array(*each)).alias("v")).select(*KEY, "v.answer", "v.token", "v.logit")


def feature_from_arrays(logits: DataFrame, mode: str = "logit", yes: str = "yes", no: str = "no") -> DataFrame:
    """F10/F11 (or F12 with ``mode='prob'``) on the array form: no shuffle."""
    y, n = F.col(yes), F.col(no)
    value = prob_diff_from_lse(lse_array(y), lse_array(n)) if mode == "prob" else logit_diff(y, n)
    return logits.select(*KEY, value.alias("value"))


def probe_arrays(texts: DataFrame, cat: DataFrame) -> DataFrame:
    """Every text's probe features in catalogue order, one row per text:
    ``(dataset, row_id, x ARRAY<DOUBLE>)``, without expanding the text."""
    variants = variant_rows(ANSWERS)
    chars = characters([t for _, t, _ in variants])
    weights = F.from_json(F.lit(json.dumps([question_weights(q["question"], chars) for q in local_list(cat)])), "array<array<int>>")

    yes, no = logit_arrays(variants, list(ANSWERS), chars, "w", "logs")
    # counted once per text: a generator keeps the counts from being inlined for every question
    rows = texts.select("dataset", "row_id", F.explode_outer(F.array(log_counts("text", chars))).alias("logs"), weights.alias("weights"))
    logits = F.expr(f"transform(weights, w -> named_struct('yes', {yes}, 'no', {no}))")
    return rows.select("dataset", "row_id", F.transform(logits, lambda a: logit_diff(a["yes"], a["no"])).alias("x"))


def rating_features(cat: DataFrame) -> DataFrame:
    """The rating prompt of each predicate through the same rule; there
    is no question apart from it."""
    variants = variant_rows(ANSWERS)
    chars = characters([t for _, t, _ in variants])
    own = logit_arrays(variants, list(ANSWERS), chars, "w", "logs")
    rows = rating_prompts(cat).select("qid", log_counts("prompt", chars).alias("logs"), F.expr(f"array_repeat(1, {len(chars)})").alias("w"))
    return rows.select("qid", logit_diff(*map(F.expr, own)).alias("value"))


#: Width of a bin of logits: e^16 is far from a double's range, and few bins hold a prompt's logits.
LSE_STEP = 16.0


def log_masses(logits: DataFrame, answers: Sequence[str]) -> DataFrame:
    """F10 on a long logits table of any number of tokens a prompt:
    ``(dataset, row_id, qid, lse ARRAY<DOUBLE>)``, the log-sum-exp of each of
    ``answers`` and, last, of all tokens; null where there is none.

    A bin's state (its number, the sum of ``exp(logit - bin start)``) adds up,
    so each task sends a row per prompt and bin, not its tokens; the bins of a
    prompt are few and are put together relative to the highest. Null and
    non-finite logits have no mass."""
    finite = F.col("logit").isNotNull() & ~F.isnan("logit") & (F.abs("logit") < F.lit(float("inf")))
    own = logits.where(finite).withColumn("_b", F.floor(F.col("logit") / LSE_STEP).cast("double"))
    mass = F.exp(F.col("logit") - F.col("_b") * LSE_STEP)
    masses = [F.sum(F.when(F.col("answer") == a, mass)).alias(f"_m{i}") for i, a in enumerate(answers)]
    bins = own.groupBy(*KEY, "_b").agg(*masses, F.sum(mass).alias(f"_m{len(answers)}"))
    kept = bins.groupBy(*KEY).agg(F.collect_list(F.struct(
        "_b", F.array(*[f"_m{i}" for i in range(len(answers) + 1)]).alias("m"))).alias("_s"))

    def lse(i):
        of = F.filter("_s", lambda s: s["m"][i].isNotNull())
        top = F.array_max(F.transform(of, lambda s: s["_b"]))
        total = F.aggregate(F.array_sort(of), F.lit(0.0),
                            lambda acc, s: acc + s["m"][i] * F.exp((s["_b"] - top) * LSE_STEP))
        return F.when(F.size(of) > 0, top * LSE_STEP + F.log(total))

    return kept.select(*KEY, F.array(*[lse(i) for i in range(len(answers) + 1)]).alias("lse"))


def feature_from_logits(logits: DataFrame, mode: str = "logit",
                        yes: str = "yes", no: str = "no") -> DataFrame:
    """F10/F11 on a long logits table; with ``mode='prob'`` F12 over the two
    answers' tokens, with ``mode='full'`` F12 over all tokens of the table."""
    ly, ln, every = (F.col("lse")[i] for i in range(3))
    value = {"logit": ly - ln, "prob": prob_diff_from_lse(ly, ln), "full": prob_diff_from_lse(ly, ln, every)}[mode]
    return log_masses(logits, [yes, no]).select(*KEY, value.alias("value"))


def top_tokens(logits: DataFrame, k: int = 5) -> DataFrame:
    """T2 + F13: the k most likely scored tokens of each prompt (softmax over
    the scored tokens). The rank filter is a literal, so a task sends at most
    k tokens a prompt, and the denominator comes from ``log_masses``."""
    from pyspark.sql import Window
    ranked = logits.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("logit"), "token")))
    return (ranked.where(F.col("rank") <= k).join(log_masses(logits, []), KEY)
            .select(*KEY, "rank", "token", F.exp(F.col("logit") - F.element_at("lse", -1)).alias("prob")))


# ---- scorer path (mapInArrow) -----------------------------------------------

def budget_batches(lengths: Sequence[int], budget: int = TOKEN_BUDGET) -> list[int]:
    """Batch number of each row of a length-sorted run: a batch grows
    while rows x longest <= budget; a single row above the budget is its own
    batch."""
    bounds, open_at = _batch_bounds(list(lengths), budget)
    ids = []
    for b, (a, e) in enumerate(bounds):
        ids += [b] * (e - a)
    return ids + [len(bounds)] * (len(lengths) - open_at)


SCORED_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("row_id", T.LongType()),
    T.StructField("qid", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("batch_id", T.StringType()), T.StructField("batch_rows", T.IntegerType()),
    T.StructField("batch_maxlen", T.IntegerType()), T.StructField("batch_seconds", T.DoubleType()),
])


def _batch_bounds(lengths, budget):
    """M12 on a length-sorted run: ``(closed batches [(start, end)], start of
    the open batch)``. The open batch may continue in the next Arrow batch."""
    bounds, start, n, mx = [], 0, 0, 0
    for i, L in enumerate(lengths):
        cand = L if L > mx else mx
        if n and (n + 1) * cand > budget:
            bounds.append((start, i))
            start, n, cand = i, 0, L
        n += 1
        mx = cand
    return bounds, start


def _score_partitions(scorer, yes_tokens, no_tokens, budget, mode):
    tokens = list(yes_tokens) + list(no_tokens)
    ny = len(yes_tokens)

    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        seq = 0

        def flush(rb, seq):
            t0 = time.perf_counter()
            lg = np.asarray(scorer(rb, tokens), dtype=np.float64).reshape(rb.num_rows, len(tokens))
            secs = time.perf_counter() - t0
            ly = np_lse(lg[:, :ny]) if ny else np.full(rb.num_rows, np.nan)
            ln = np_lse(lg[:, ny:]) if len(tokens) > ny else np.full(rb.num_rows, np.nan)
            if mode == "prob":
                m = np.maximum(ly, ln)
                a, b = np.exp(ly - m), np.exp(ln - m)
                val = (a - b) / (a + b)
            else:
                val = ly - ln
            n = rb.num_rows
            mx = int(np.max(rb.column("prompt_len").to_numpy(zero_copy_only=False)))
            return pa.RecordBatch.from_arrays(
                [rb.column("dataset"), rb.column("row_id"), rb.column("qid"), pa.array(val, pa.float64()),
                 pa.array([f"{part}-{seq}"] * n, pa.string()), pa.array(np.full(n, n, np.int32)),
                 pa.array(np.full(n, mx, np.int32)), pa.array(np.full(n, secs / max(n, 1)))],
                names=["dataset", "row_id", "qid", "value", "batch_id", "batch_rows", "batch_maxlen",
                       "batch_seconds"])

        carry = None
        for rb in it:
            if carry is not None and carry.num_rows:
                rb = pa.concat_batches([carry, rb])
            lens = rb.column("prompt_len").to_numpy(zero_copy_only=False).tolist()
            bounds, open_at = _batch_bounds(lens, budget)
            for a, b in bounds:
                yield flush(rb.slice(a, b - a), seq)
                seq += 1
            carry = rb.slice(open_at)
        if carry is not None and carry.num_rows:
            yield flush(carry, seq)
    return run


def score(prompts_df: DataFrame, scorer: Callable | None = None,
          yes_tokens: Sequence[str] | None = None, no_tokens: Sequence[str] | None = None,
          budget: int = TOKEN_BUDGET, mode: str = "logit") -> DataFrame:
    """The scoring job. T1 sorts prompts by length inside each
    partition - batches never span partitions, so a global sort would buy
    no padding and cost a shuffle of every prompt text; M12 forms budget
    batches in that order (an open batch carries over Arrow batches); the
    scorer sees one batch at a time."""
    scorer = scorer or LexicalScorer()
    from probelab.session import ship_package
    ship_package(prompts_df.sparkSession)
    yes_tokens = yes_tokens or [t for a, t, _ in variant_rows({"yes": YES_WORDS})]
    no_tokens = no_tokens or [t for a, t, _ in variant_rows({"no": NO_WORDS})]
    p = prompts_df.select(*KEY, "prompt", F.col("prompt_len").cast("int"))
    p = p.sortWithinPartitions("prompt_len", *KEY)
    return p.mapInArrow(_score_partitions(scorer, yes_tokens, no_tokens, budget, mode), SCORED_SCHEMA)


def scoring_metrics(scored: DataFrame) -> DataFrame:
    """Prompts, batches, scorer seconds and prompts per second per
    dataset (``batch_seconds`` holds each row's share of its batch's time)."""
    return (scored.groupBy("dataset")
                  .agg(F.count(F.lit(1)).alias("n_prompts"), F.countDistinct("batch_id").alias("n_batches"),
                       F.sum("batch_seconds").alias("scorer_seconds"),
                       F.sum("batch_maxlen").alias("padded_tokens"))
                  .withColumn("prompts_per_sec", F.col("n_prompts") / F.col("scorer_seconds")))


# ---- S9: resume -------------------------------------------------------------

def pending(prompts_df: DataFrame, done: DataFrame) -> DataFrame:
    """Prompts whose key is not in the written output (row-level resume)."""
    return prompts_df.join(done.select(*KEY).distinct(), KEY, "left_anti")


def run_resumable(prompts_df: DataFrame, out_path: str, scorer: Callable | None = None,
                  **kw) -> DataFrame:
    """Score what is missing from ``out_path`` and append it (partitioned by
    dataset). A rerun over a complete output adds nothing."""
    spark = prompts_df.sparkSession
    todo = prompts_df
    if _exists(spark, out_path):
        todo = pending(prompts_df, spark.read.parquet(out_path))
    scored = score(todo, scorer, **kw).select(*KEY, "value")
    scored.write.mode("append").partitionBy("dataset").parquet(out_path)
    return spark.read.parquet(out_path)


FEATURE_SCHEMA = "row_id bigint, qid string, value double, dataset string"


def run_missing(texts: DataFrame, cat: DataFrame, out_path: str, scorer: Callable | None = None, **kw) -> None:
    """S9 from texts: score the questions that ``out_path`` does not hold for a
    row and append them, partitioned by dataset. A row key that ``texts``
    repeats counts once, with the smallest text. Running it again, after a
    failure too, gives no key twice: what was committed is left out, what was
    not is scored again. One writer at a time."""
    spark = texts.sparkSession
    done = spark.read.schema(FEATURE_SCHEMA).parquet(out_path) if _exists(spark, out_path) else None
    once = texts.groupBy("dataset", "row_id").agg(F.min("text").alias("text"))
    scored = score(prompts(once, cat, done), scorer, **kw).select(*KEY, "value")
    scored.write.mode("append").partitionBy("dataset").parquet(out_path)


def _exists(spark, path: str) -> bool:
    """Whether an output path exists (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
