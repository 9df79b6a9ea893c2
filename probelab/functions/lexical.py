"""A scorer that reads the texts: answer logits from character counts.

The logit of an answer token after a prompt is the mean, over the token's
characters c, of ``(1 + count of c in the question) * ln(1 + count of c in the
text)``. It knows no language, but every number follows from the text and the
question, a change of either changes it, and any SQL engine can state it. A
model scorer takes its place through the scorer contract of
``operators.scoring``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelab.functions.logits import lse_array
from probelab.session import ship_package

ASK = "\n\nQuestion: "


def characters(tokens: Sequence[str]) -> list[str]:
    """The distinct characters of tokens, in order of their code points."""
    return sorted(set("".join(tokens)))


def log_counts(text: str, chars: Sequence[str]) -> Column:
    """``ln(1 + count)`` of each character, once per text."""
    quoted = [c.replace("\\", "\\\\").replace("'", "\\'") for c in chars]
    return F.expr("array(" + ", ".join(f"ln(1D + length({text}) - length(replace({text}, '{c}', '')))" for c in quoted) + ")")


def question_weights(question: str, chars: Sequence[str]) -> list[int]:
    return [1 + question.count(c) for c in chars]


def logit_arrays(variants: Sequence[tuple], answers: Sequence[str], chars: Sequence[str], weights: str, logs: str) -> list[str]:
    """SQL of an array of logits for each answer, in the order of its
    variants; ``weights`` and ``logs`` name a question's and a text's arrays."""
    def logit(token: str) -> str:
        at = [chars.index(c) for c in token]
        return "(" + " + ".join(f"{weights}[{i}] * {logs}[{i}]" for i in at) + f") / {len(at)}D"
    return ["array(" + ", ".join(logit(t) for a, t, _ in variants if a == answer) + ")" for answer in answers]


def _counted(texts: pa.Array, chars: Sequence[str]) -> np.ndarray:
    """How often each character occurs in each text (0 in a null one)."""
    out = np.zeros((len(texts), len(chars)), np.int32)
    one = [i for i, c in enumerate(chars) if len(c.encode()) == 1]
    code = np.array([ord(chars[i]) for i in one], np.int64)
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else []
    octets = np.frombuffer(data or b"", np.uint8)
    for i, (a, e) in enumerate(zip(at[:-1], at[1:])):
        if e > a:                       # UTF-8: a byte below 128 is a character of its own
            out[i, one] = np.bincount(octets[a:e], minlength=256)[code]
    for i in set(range(len(chars))) - set(one):
        out[:, i] = pc.fill_null(pc.count_substring(texts, chars[i]), 0).to_numpy(zero_copy_only=False)
    return out


def count_characters(df: DataFrame, text: str, chars: Sequence[str], out: str = "counts") -> DataFrame:
    """``df`` with the counts of the characters in place of the text: one pass
    over each text, whatever the number of characters."""
    ship_package(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for rb in batches:
            n = _counted(rb.column(text), chars)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(chars)), pa.array(n.ravel()),
                                             mask=rb.column(text).is_null())
            yield pa.RecordBatch.from_arrays([*(rb.column(f.name) for f in rest), lists], [*(f.name for f in rest), out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def character_places(word: Column, chars: Sequence[str]) -> Column:
    """The place of each character of a word in ``chars``, from 1; 0: elsewhere."""
    known = F.array(*[F.lit(c) for c in chars])
    return F.transform(F.split(word, ""), lambda c: F.array_position(known, c).cast("int"))


def option_score(logs: Column, spellings: Column) -> Column:
    """Log-sum-exp over an option's spellings (``character_places``) of the mean
    ``ln(1 + count)`` of its characters in the text; ``logs`` begins with that
    of a character which is not counted, 0."""
    def mean(places: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.element_at(logs, i + 1)) / F.size(places)
    # the means are the argument of a transform, so that they are computed once
    return F.element_at(F.transform(F.array(F.transform(spellings, mean)), lse_array), 1)


class LexicalScorer:
    """The same rule under the scorer contract: ``(batch, tokens) -> logits``,
    reading the text and the question from each prompt. A prompt without a
    question (a rating prompt) is all text."""

    def __call__(self, batch, tokens: Sequence[str]) -> np.ndarray:
        chars = characters(tokens)
        share = np.array([[t.count(c) / len(t) for t in tokens] for c in chars])
        known: dict[str, np.ndarray] = {}

        def counts(s: str) -> np.ndarray:
            if s not in known:
                known[s] = np.array([s.count(c) for c in chars], float)
            return known[s]
        rows = np.zeros((batch.num_rows, len(chars)))
        for i, prompt in enumerate(batch.column("prompt").to_pylist()):
            text, asked, rest = prompt.rpartition(ASK)
            if not asked:
                text, rest = prompt, ""
            rows[i] = (1 + counts(rest.partition("\n")[0])) * np.log(1 + counts(text))
        return rows @ share
