"""Logit algebra.

Array form (one row per prompt, a logit array per answer) needs no shuffle;
long form (one row per prompt and token) aggregates by prompt key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Answer words whose variants are read at the answer slot.
YES_WORDS = ["yes", "Yes", "YES"]
NO_WORDS = ["no", "No", "NO"]

VARIANT_SCHEMA = T.StructType([
    T.StructField("answer", T.StringType(), False),
    T.StructField("token", T.StringType(), False),
    T.StructField("n_pieces", T.IntegerType(), False),
])


def variant_rows(answers: dict[str, Sequence[str]],
                 pieces: Callable[[str], int] | None = None) -> list[tuple]:
    """{w, " "+w} for every word of an answer; only single-piece variants
    are kept, distinct and sorted. ``pieces`` counts tokenizer pieces of a
    string (all single-piece when no tokenizer is given)."""
    place = {answer: i for i, answer in enumerate(answers)}
    spelled = {(place[answer], answer, lead + w) for answer in answers for w in answers[answer] for lead in ("", " ")}
    return [(answer, token, 1) for _, answer, token in sorted(spelled) if pieces is None or pieces(token) == 1]


def answer_variants(spark: SparkSession, answers: dict[str, Sequence[str]] | None = None,
                    pieces: Callable[[str], int] | None = None) -> DataFrame:
    answers = answers or {"yes": YES_WORDS, "no": NO_WORDS}
    return spark.createDataFrame(variant_rows(answers, pieces), VARIANT_SCHEMA)


# ---- log-sum-exp -----------------------------------------------------------

def lse_array(arr: Column) -> Column:
    """F10 on an array: max + log(sum(exp(x - max))); null for an empty array."""
    m = F.array_max(arr)
    s = F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return F.when(F.size(arr) > 0, m + F.log(s))


def logit_diff(yes: Column, no: Column) -> Column:
    """lse(yes) - lse(no)."""
    return lse_array(yes) - lse_array(no)


def prob_diff_from_lse(lse_yes: Column, lse_no: Column, lse_all: Column | None = None) -> Column:
    """P(yes) - P(no). With ``lse_all`` (log-sum-exp over the full
    vocabulary) it is a difference of full-softmax masses; without, the
    softmax runs over the scored answer tokens only."""
    if lse_all is not None:
        return F.exp(lse_yes - lse_all) - F.exp(lse_no - lse_all)
    m = F.greatest(lse_yes, lse_no)
    a, b = F.exp(lse_yes - m), F.exp(lse_no - m)
    return (a - b) / (a + b)


def softmax_array(arr: Column) -> Column:
    """F13 on an array."""
    lse = lse_array(arr)
    return F.transform(arr, lambda x: F.exp(x - lse))


def np_lse(x: np.ndarray, axis: int = -1) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    return (m + np.log(np.sum(np.exp(x - m), axis=axis, keepdims=True))).squeeze(axis)
