"""Text cleaning expressions (F1-F4). All JVM-side, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference for equal results):
#   line-break tag pattern: <br\s*/?>  (case-sensitive, replaced by one space)
#   word limit: 300 words, split on a single space
BREAK_TAG = r"<br\s*/?>"
MAX_WORDS = 300

# Java's Unicode \s leaves out U+001C..U+001F, which Python's str-regex \s
# matches; the class adds them so the collapse agrees with Python semantics.
UNICODE_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_breaks(col) -> Column:
    """replace line-break tags by a space."""
    return F.regexp_replace(_c(col), BREAK_TAG, " ")


def collapse_whitespace(col) -> Column:
    """every run of Unicode whitespace becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(_c(col), UNICODE_SPACE_RUN, " "))


def first_words(col, n: int = MAX_WORDS) -> Column:
    """keep the first ``n`` words (split on one space). A bounded regex
    stops after ``n`` words instead of splitting a 20,000-word text."""
    return F.regexp_extract(_c(col), f"^[^ ]*+(?: [^ ]*+){{0,{n - 1}}}+", 0)


def clean_text(col, max_words: int | None = MAX_WORDS) -> Column:
    """F1 -> F2 -> F3, the reference's truncation of one text; without
    ``max_words`` the text stays whole."""
    whole = collapse_whitespace(strip_breaks(col))
    return whole if max_words is None else first_words(whole, max_words)


def has_content(col) -> Column:
    """P4 decided on the raw text: cleaning leaves something exactly when the
    text, without line-break tags, holds a character that is not whitespace.
    The pattern looks for that one character, so no run of blanks or tags,
    however long, is matched as a whole."""
    bare = F.regexp_replace(_c(col), r"(?U)<br\s*+/?>", "")
    return bare.rlike(r"(?U)[^\s\x1c-\x1f]")


def word_count(col) -> Column:
    """number of words of a cleaned text (0 for an empty text)."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(space_count(c) + 1)


def space_count(col) -> Column:
    """Number of ' ' characters (no array is built)."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
