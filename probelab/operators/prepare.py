"""Dataset preparation.

A prepared dataset is one table for all datasets:
``dataset STRING, row_id BIGINT, text STRING, label INT, label_text STRING``.
``row_id`` is the stable identity every later join uses (the reference is
positional; Spark has no row order).

Plan shape: scan -> null drop -> clean (codegen) -> non-empty filter ->
row_number with a literal limit (``WindowGroupLimit`` keeps at most
``quota`` rows per class in every map task, so a hot class never reaches one
task whole) -> shuffle on (dataset, label) of the survivors only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelab.functions.text import MAX_WORDS, clean_text, has_content, word_count

# The reference's sample size and sampling seed.
N_TOTAL = 500
SEED = "12345"

PREPARED_COLUMNS = ["dataset", "row_id", "text", "label", "label_text"]


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Fail before any action, naming the columns that are there."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the input has {df.columns}")


def labelled_text(df: DataFrame, dataset: str, *, id_col: str, text_col: str = "text",
                  label_col: str = "label", label_text_col: str | None = None,
                  names: Sequence[str] | None = None) -> DataFrame:
    """S1 + P1 + P5: bring any labelled text table to the common shape.

    * string label column -> ``label_text`` is it, ``label`` is its index in
      the sorted class list of the dataset (T4);
    * integer label column -> ``label`` is it, ``label_text`` is the optional
      text column if present (P1), else ``names[label]``, else the label as a
      string (P5).
    """
    require_columns(df, [id_col, text_col, label_col])
    dtype = dict(df.dtypes)[label_col]
    base = df.select(F.lit(dataset).alias("dataset"),
                     F.col(id_col).cast("bigint").alias("row_id"),
                     F.col(text_col).alias("text"),
                     F.col(label_col).alias("_label"),
                     *([F.col(label_text_col).alias("_label_text")]
                       if label_text_col and label_text_col in df.columns else []))
    if dtype == "string":
        return base.withColumn("label_text", F.col("_label")).drop("_label")
    out = base.withColumn("label", F.col("_label").cast("int")).drop("_label")
    return out.withColumn("label_text", label_name(F.col("label"), names,
                                                   F.col("_label_text") if "_label_text" in out.columns else None)) \
              .drop("_label_text")


def label_name(label: Column, names: Sequence[str] | None = None,
               given: Column | None = None) -> Column:
    """P5: given text, else index into ``names``, else the label as a string."""
    parts = []
    if given is not None:
        parts.append(given)
    if names:
        parts.append(F.try_element_at(F.array(*[F.lit(n) for n in names]), label + 1))
    parts.append(label.cast("string"))
    return F.coalesce(*parts)


def clean(df: DataFrame, max_words: int | None = MAX_WORDS) -> DataFrame:
    """P3 -> P4 -> F1/F2/F3: drop null text, drop text that cleaning would
    empty, clean and truncate. P4 is tested on the raw text (same rows as
    ``length(cleaned) > 0``): a filter on the cleaned column would be pushed
    below the projection and run the cleaning twice."""
    return (df.na.drop(subset=["text"])
              .filter(has_content(F.col("text")))
              .withColumn("text", clean_text(F.col("text"), max_words)))


def index_labels(df: DataFrame) -> DataFrame:
    """Give string-labelled rows an INT ``label``: the position of the
    class in the sorted class list of its dataset. The class table is
    broadcast after a count proves it small, so a hot class never decides a
    shuffle partition."""
    if "label" in df.columns:
        return df
    classes = (df.select("dataset", "label_text").distinct()
                 .withColumn("label", (F.dense_rank().over(
                     Window.partitionBy("dataset").orderBy("label_text")) - 1).cast("int")))
    from probelab.operators.joins import checked_broadcast_join
    return checked_broadcast_join(df, classes, ["dataset", "label_text"])


def seeded_order(seed: str, tag: str = "") -> Column:
    """Deterministic pseudo-random order key (W1/W2). md5 of ``seed:tag:row_id``
    gives the same order in Spark and in any SQL engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:{tag}"), F.col("row_id").cast("string")))


def balanced_sample(df: DataFrame, n_total: int = N_TOTAL, seed: str = SEED) -> DataFrame:
    """Up to ``n_total // n_classes`` rows per class, seeded; classes
    smaller than the quota give all their rows (no upsampling)."""
    counts = {r["dataset"]: r["n_classes"] for r in
              df.groupBy("dataset").agg(F.countDistinct("label").alias("n_classes")).collect()}
    if not counts:
        return df
    quotas = {d: n_total // k for d, k in counts.items()}
    top = max(quotas.values())
    w = Window.partitionBy("dataset", "label").orderBy(seeded_order(seed, "b"), F.col("row_id"))
    quota_of = F.element_at(F.create_map(*[x for d, q in quotas.items()
                                           for x in (F.lit(d), F.lit(q))]), F.col("dataset"))
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= top)          # literal: WindowGroupLimit
              .filter(F.col("_rn") <= quota_of)     # exact per-dataset quota
              .drop("_rn"))


def with_shuffle_key(df: DataFrame, seed: str = SEED) -> DataFrame:
    """A seeded permutation as a column; sort on it only when order is asked for."""
    return df.withColumn("shuffle_key", seeded_order(seed, "s"))


def prepare(raw: DataFrame, n_total: int = N_TOTAL, max_words: int = MAX_WORDS,
            seed: str = SEED) -> DataFrame:
    """Section A of the lifecycle as one lazy plan."""
    require_columns(raw, ["dataset", "row_id", "text", "label_text"])
    cleaned = index_labels(clean(raw, max_words))
    sampled = balanced_sample(cleaned, n_total, seed)
    return with_shuffle_key(sampled.select(*PREPARED_COLUMNS), seed)


# ---- A1-A4: per-dataset descriptions --------------------------------------

def class_distribution(prepared: DataFrame) -> DataFrame:
    """A1: rows per class, descending."""
    return (prepared.groupBy("dataset", "label", "label_text").agg(F.count(F.lit(1)).alias("n"))
                    .orderBy("dataset", F.desc("n"), "label"))


def chance(prepared: DataFrame) -> DataFrame:
    """A2: majority-class share per dataset."""
    per = prepared.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dataset").agg((F.max("n") / F.sum("n")).alias("chance"))


def dataset_meta(prepared: DataFrame) -> DataFrame:
    """A3 + A4 + T4: n, sorted class names, n_classes, distribution map, mean
    words - one scan: per-class counts and word sums, then per dataset."""
    per_class = prepared.groupBy("dataset", "label_text").agg(
        F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("words"))
    return (per_class.groupBy("dataset").agg(
                F.sum("n").alias("n"),
                F.sort_array(F.collect_list("label_text")).alias("classes"),
                F.map_from_entries(F.collect_list(F.struct("label_text", "n"))).alias("dist"),
                (F.sum("words") / F.sum("n")).alias("mean_words"))
            .withColumn("n_classes", F.size("classes").cast("bigint"))
            .select("dataset", "n", "classes", "n_classes", "dist", "mean_words"))
