"""Prompt templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wording the scores depend on.
#   yes/no probe   : "<text>\n\nQuestion: <question>\nAnswer with only 'yes' or 'no'."
#   rating probe   : 'When the adjective "<predicate>" is used in everyday English, is it
#                    often used figuratively or metaphorically to describe something
#                    non-physical (for example a mood, a person, or a situation)?'
#                    + "\nAnswer with only 'yes' or 'no'."
#   multiple choice: "<instruction>\n\nText: <text>\n\nOptions:\n(A) x\n(B) y\n\n"
#                    + "Answer with the letter of the correct option only."
#   option letters : A B C D E F
ANSWER_YES_NO = "\nAnswer with only 'yes' or 'no'."
RATING_HEAD = 'When the adjective "'
RATING_TAIL = ('" is used in everyday English, is it often used figuratively or '
               'metaphorically to describe something non-physical (for example a mood, '
               'a person, or a situation)?')
MC_TAIL = "\n\nAnswer with the letter of the correct option only."
LETTERS = ["A", "B", "C", "D", "E", "F"]


def yes_no_prompt(text: Column, question: Column) -> Column:
    """F5."""
    return F.concat(text, F.lit("\n\nQuestion: "), question, F.lit(ANSWER_YES_NO))


def rating_prompt(predicate: Column) -> Column:
    """asks how figurative a predicate is; no text side."""
    return F.concat(F.lit(RATING_HEAD), predicate, F.lit(RATING_TAIL), F.lit(ANSWER_YES_NO))


def options_block(displays: Column) -> Column:
    """F7 helper: ``(A) x\n(B) y ...`` from an ordered array of display names."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(displays, lambda d, i: F.concat(F.lit("("), F.element_at(letters, i + 1),
                                                          F.lit(") "), d))
    return F.array_join(lines, "\n")


def mc_prompt(instr: Column, text: Column, block: Column) -> Column:
    """F7."""
    return F.concat(instr, F.lit("\n\nText: "), text, F.lit("\n\nOptions:\n"), block, F.lit(MC_TAIL))


def length_proxy(prompt: Column) -> Column:
    """Prompt length in space-separated pieces: the default stand-in for a
    tokenizer's count (a scorer may bring its own length column)."""
    return F.size(F.split(prompt, " "))
