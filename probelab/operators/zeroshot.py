"""Zero-shot multiple choice.

Config table ``(dataset, instr, opt_idx, label_text, display)``: the
instruction and, per class, the display name shown as an option. Options
are the distinct display names in first-appearance order (P12), lettered
A, B, ... Each text gets one prompt; a scorer gives one score per option
(log-sum-exp over the option's variants), the arg-max is the prediction
(first option wins ties, W7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelab.functions.lexical import character_places, characters, count_characters, option_score
from probelab.functions.prompts import LETTERS, mc_prompt, options_block
from probelab.operators.joins import checked_broadcast_join

ZS_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False), T.StructField("instr", T.StringType(), False),
    T.StructField("opt_idx", T.IntegerType(), False), T.StructField("label_text", T.StringType(), False),
    T.StructField("display", T.StringType(), False),
])


def options(cfg: DataFrame) -> DataFrame:
    """P12 + letters: ``(dataset, display, option, letter)`` - distinct
    display names ordered by their first ``opt_idx``."""
    first = cfg.groupBy("dataset", "display").agg(F.min("opt_idx").alias("_first"))
    w = Window.partitionBy("dataset").orderBy("_first")
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return (first.withColumn("option", (F.row_number().over(w) - 1).cast("int"))
                 .withColumn("letter", F.element_at(letters, F.col("option") + 1))
                 .select("dataset", "display", "option", "letter"))


def gold(cfg: DataFrame) -> DataFrame:
    """F8 + J6: label text -> option index of its display name."""
    return cfg.select("dataset", "label_text", "display").join(options(cfg), ["dataset", "display"]) \
              .select("dataset", "label_text", F.col("option").alias("gold"))


def prompts(texts: DataFrame, cfg: DataFrame) -> DataFrame:
    """one prompt per text; the option block is built once per dataset
    (config-sized) and joined by dataset (broadcast: one row per dataset)."""
    opts = options(cfg)
    block = (opts.groupBy("dataset")
                 .agg(F.sort_array(F.collect_list(F.struct("option", "display"))).alias("_o"))
                 .select("dataset", options_block(F.transform("_o", lambda s: s["display"])).alias("block"),
                         F.size("_o").alias("n_options")))
    instr = cfg.select("dataset", "instr").distinct()
    meta = F.broadcast(block.join(instr, "dataset"))
    return (texts.join(meta, "dataset")
                 .select("dataset", "row_id", "label_text", "n_options",
                         mc_prompt(F.col("instr"), F.col("text"), F.col("block")).alias("prompt")))


def option_scores(texts: DataFrame, cfg: DataFrame) -> DataFrame:
    """Per text one score per option of its dataset, in option order, by the
    character rule: ``(dataset, row_id, label_text, scores ARRAY<DOUBLE>)``. An
    option is spelled with and without a leading space. The characters of all
    options are counted in one pass over each text; the options are config-sized
    and joined by dataset."""
    opts = options(cfg)
    chars = characters([" ", *(r["c"] for r in opts.select(F.explode(F.split("display", "")).alias("c")).distinct().collect())])
    spelled = F.array(character_places(F.col("display"), chars), character_places(F.concat(F.lit(" "), F.col("display")), chars))
    opts = (opts.select("dataset", "option", spelled.alias("spelled")).groupBy("dataset")
            .agg(F.sort_array(F.collect_list(F.struct("option", "spelled"))).alias("_o"))
            .select("dataset", F.transform("_o", lambda o: o["spelled"]).alias("_o")))
    counted = count_characters(texts.select("dataset", "row_id", "label_text", "text"), "text", chars)
    logs = F.concat(F.array(F.lit(0.0)), F.transform("counts", lambda n: F.log(1.0 + n)))
    scores = F.transform("_o", lambda spellings: option_score(F.col("logs"), spellings))
    return (checked_broadcast_join(counted.select("dataset", "row_id", "label_text", logs.alias("logs")), opts, ["dataset"])
            .select("dataset", "row_id", "label_text", scores.alias("scores")))


def predict(scored: DataFrame, cfg: DataFrame) -> DataFrame:
    """Arg-max option, the first of equal scores; joined to the gold option."""
    best = F.array_position(F.col("scores"), F.array_max("scores")) - 1
    return (scored.withColumn("pred", best.cast("int"))
                  .transform(lambda d: checked_broadcast_join(d, gold(cfg), ["dataset", "label_text"]))
                  .select("dataset", "row_id", "label_text", "gold", "pred"))


def histogram(pred: DataFrame, cfg: DataFrame) -> DataFrame:
    """Predictions per option letter, zero-filled."""
    opts = options(cfg).select("dataset", F.col("option").alias("pred"), "letter")
    cnt = pred.groupBy("dataset", "pred").agg(F.count(F.lit(1)).alias("n"))
    return opts.join(cnt, ["dataset", "pred"], "left").select(
        "dataset", "letter", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
