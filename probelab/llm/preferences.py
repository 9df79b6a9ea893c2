"""Preference formatting of chosen and rejected conversations.

Both sides are long tables of turns. Turns are matched on (pair, turn): the
first turn at which the sides differ, in role or text or because one side has
ended, ends the longest common prefix. The prefix is rendered once, as
prompt; what follows on either side is rendered as its completion, in which
only assistant turns carry the loss mask. Output is one row per rendered
turn, so a conversation of any length is many rows and never one group; the
split is a map-side-combined minimum per pair.

Defined results: rows without a pair or a turn number have no place and are
left out; a null role or text renders as empty and equals only null. Rows
that repeat a turn count once; where they differ, the smallest (role, text)
stands. Equal sides are all prompt, with no completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def render(role: Column, text: Column, template=TEMPLATE) -> Column:
    opening, between, closing = map(F.lit, template)
    return F.concat(opening, F.coalesce(role, F.lit("")), between, F.coalesce(text, F.lit("")), closing)


def _turns(side: DataFrame) -> DataFrame:
    return (side.where("pair_id is not null and turn is not null").groupBy("pair_id", "turn")
            .agg(F.min(F.struct("role", "text")).alias("said")))


def format_preferences(chosen: DataFrame, rejected: DataFrame, template=TEMPLATE) -> DataFrame:
    """``chosen`` and ``rejected`` (pair_id, turn, role, text) to rows
    (pair_id, part, turn, role, segment, loss): part is prompt, chosen or
    rejected, segment the rendered turn, loss whether it is trained on."""
    c, r = _turns(chosen).withColumnRenamed("said", "c"), _turns(rejected).withColumnRenamed("said", "r")
    both = c.join(r, ["pair_id", "turn"], "full")
    differ = ~F.col("c").eqNullSafe(F.col("r"))
    splits = both.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("split"))
    placed = both.join(splits, "pair_id")
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    row = lambda part, said: F.struct(F.lit(part).alias("part"), F.col(said).alias("said"))
    parts = F.when(common, F.array(row("prompt", "c"))).otherwise(F.array(row("chosen", "c"), row("rejected", "r")))
    rows = placed.select("pair_id", "turn", F.explode(parts).alias("p")).where("p.said is not null")
    role, text = F.col("p.said.role"), F.col("p.said.text")
    loss = (F.col("p.part") != "prompt") & role.eqNullSafe(F.lit("assistant"))
    return rows.select("pair_id", F.col("p.part").alias("part"), "turn", role.alias("role"), render(role, text, template).alias("segment"), loss.alias("loss"))


def stale_reply_pairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) from ``turns(conv_id, turn, role, text)``: chosen is
    the conversation up to its last assistant turn, rejected the same with
    that turn's text replaced by the assistant turn before it, a reply that
    ignores the last question. With one assistant turn the rejected side ends
    before it. Conversations without one give no pair."""
    t = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").where("pair_id is not null and turn is not null")
    said = t.where("role = 'assistant'").groupBy("pair_id", "turn").agg(F.min("text").alias("text"))
    last = said.groupBy("pair_id").agg(F.max("turn").alias("last"))
    before = (said.join(last, "pair_id").where("turn < last").groupBy("pair_id", "last")
              .agg(F.max_by("text", "turn").alias("text")))
    upto = t.join(last, "pair_id").where("turn <= last")
    chosen = upto.select("pair_id", "turn", "role", "text")
    rejected = upto.where("turn < last").select("pair_id", "turn", "role", "text").union(
        before.select("pair_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), "text"))
    return chosen, rejected
