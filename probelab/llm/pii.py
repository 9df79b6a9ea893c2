"""Personal data in whole texts, with an offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. A chain of transducers
then rewrites the text - homoglyphs and full-width forms to ASCII, invisible
characters to nothing, spelled digits to digits, written-out at and dot to
``@`` and ``.`` - and every step keeps, for each stretch of its output, the
source range it stands for. Identifiers found after any step are mapped back through
these ranges to source characters. Base spans stay as they are; a mapped span
is added unless a base span of its kind covers it, so an address of which only
a part is plain is found whole, beside its plain part. Redaction covers the
union of overlapping spans.

Spelled digits are those of English, French, German and Spanish. A spoken
address needs its language's at and dot and an ending in use (``ENDINGS``, or a
country code); an ending that is also a word counts only where no word follows.

One narrow pass over the rows, no shuffle. Null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number starts a match only at its first digit: the greedy run before has
# taken the rest, so the look-behind changes no match and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local-part characters left of an ``@``,
    as far as the match before it, and the greedy domain behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (m := _DOMAIN.match(text, at)):
            left = text[free:at]
            start = free + len(left.rstrip(_LOCAL))
            if start < at:
                out.append((start, m.end()))
                free = m.end()
            else:
                free = at + 1       # nothing up to this @ can begin a later match
        elif at >= free:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in KINDS, then start."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text)
            if len(m.group()) >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# Lookalike letters of other scripts, written-out digits, and
# ways to write "at" and "dot".
HOMOGLYPHS = dict(zip(
    "АВЕКМНОРСТХаеорсухіјѕԁՕΑΒΕΖΗΙΚΜΝΟΡΤΥΧονⅼ‐‑‒–—−․。．＠",
    "ABEKMHOPCTXaeopcyxijsdOABEZHIKMNOPTYXovl------...@"))
HOMOGLYPHS |= {chr(0xFF10 + i): chr(0x30 + i) for i in range(10)}
HOMOGLYPHS |= {chr(0xFF21 + i): chr(0x41 + i) for i in range(26)}
HOMOGLYPHS |= {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)}
HOMOGLYPHS |= {chr(0x0660 + i): chr(0x30 + i) for i in range(10)}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {w: d for words in (
    "zero oh|one|two|three|four|five|six|seven|eight|nine|plus",
    "zéro|un une|deux|trois|quatre|cinq|six|sept|huit|neuf|plus",
    "null|eins ein|zwei zwo|drei|vier|fünf fuenf|sechs|sieben|acht|neun|plus",
    "cero|uno una|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|más mas")
    for d, same in zip("0123456789+", words.split("|")) for w in same.split()}
ENDINGS = "com org net edu gov mil int info biz io app dev ai eu example test invalid".split()
COUNTRIES = """ac ad ae af ag al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl
cm cn co cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er es et fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw
gy hk hm hn hr ht hu id ie il iq ir je jm jo jp ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly ma mc md mg mh
mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa
ro rs ru rw sa sb sc sd sg sh si sj sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz ua ug uk
uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
WORD_ENDINGS = "am as at be by do in is it la me my no re se so to us".split()

_GLYPH = re.compile(f"[{re.escape(''.join(HOMOGLYPHS) + INVISIBLE)}]")


def _any(words) -> str:
    """An alternation grouped by first letter."""
    by: dict = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


_DIGIT = _any(DIGIT_WORDS)
_NUMBER = re.compile(rf"\b{_DIGIT}\b(?:[\x20-](?={_DIGIT}\b))?", re.I)
_BEFORE = re.compile(rf"(?:[0-9]|\b{_DIGIT})[\x20-]$", re.I)
_REACH = max(map(len, DIGIT_WORDS)) + 2     # a word, its separator and the character before it
_AT = re.compile(r"\x20?[\[({<]\x20?(?:at|ät|arobase|arroba|@)\x20?[\])}>]\x20?", re.I)
_DOT = re.compile(r"\x20?[\[({<]\x20?(?:dot|punto|point|punkt|\.)\x20?[\])}>]\x20?", re.I)
# bare words only in the full shape of an address
_SPOKEN = [(re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(\x20{at}\x20)[A-Za-z0-9-]{{1,63}}((?:(?:\x20{dot}\x20|\.)[A-Za-z0-9-]{{1,63}})*)(\x20{dot}\x20)"
                       rf"(?:{_any(ENDINGS + COUNTRIES)}\b|{_any(WORD_ENDINGS)}\b(?!\x20\w))", re.I), re.compile(rf"\x20{at}\x20", re.I), re.compile(rf"\x20{dot}\x20", re.I))
           for at, dot in (("arobase", "(?:point|dot)"), ("(?:at|ät)", "(?:punkt|dot)"), ("arroba", "(?:punto|dot)"))]


class Tape:
    """A rewritten text and the source range that each stretch of it stands
    for: ``begin`` holds where stretches begin, ``stands`` their source start
    and, where the stretch replaces its source as a whole, the source end.
    What is kept grows with the edits, not with the text."""

    def __init__(self, text: str):
        self.text, self.begin, self.stands = text, [0], [(0, None)]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges [lo, hi) of the present text, ascending and disjoint."""
        if not edits:
            return
        text, begin, stands, at, length, i = [], [], [], 0, 0, 0
        limits = [*self.begin[1:], len(self.text)]
        for lo, hi, new in [*edits, (len(self.text), len(self.text), "")]:
            while at < lo:
                while limits[i] <= at:
                    i += 1
                stop, (start, end) = min(lo, limits[i]), self.stands[i]
                begin.append(length)
                stands.append((start + at - self.begin[i], None) if end is None else (start, end))
                length += stop - at
                text.append(self.text[at:stop])
                at = stop
            if new:
                begin.append(length)
                stands.append(self.source(lo, hi))
                length += len(new)
                text.append(new)
            at = hi
        self.text, self.begin, self.stands = "".join(text), begin or [0], stands or [(0, None)]

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        i, j = bisect_right(self.begin, lo) - 1, bisect_right(self.begin, hi - 1) - 1
        start, whole = self.stands[i]
        last, end = self.stands[j]
        return (start + lo - self.begin[i] if whole is None else start,
                last + hi - self.begin[j] if end is None else end)


def normalised(text: str) -> Iterator[Tape]:
    """The tape after each transducer that changes the text: a later step may
    hide what an earlier one shows (a number word before a disguised card)."""
    tape = Tape(text)
    if not text.isascii() and _GLYPH.search(text):
        tape.rewrite([(*m.span(), HOMOGLYPHS.get(m.group(), "")) for m in _GLYPH.finditer(text)])
        yield tape
    if edits := [(*m.span(), DIGIT_WORDS[re.match(r"\w+", m.group().lower()).group()]) for m in _NUMBER.finditer(tape.text)
                 if _in_number(tape.text, m)]:
        tape.rewrite(edits)
        yield tape
    if re.search(r"[\[({<]", tape.text):
        before = tape.text
        tape.rewrite([(*m.span(), "@") for m in _AT.finditer(tape.text)])
        tape.rewrite([(*m.span(), ".") for m in _DOT.finditer(tape.text)])
        if tape.text != before:
            yield tape
    for spoken, at, dot in _SPOKEN:
        if not (dot.search(tape.text) and at.search(tape.text)):
            continue
        edits = []
        for m in spoken.finditer(tape.text):
            edits.append((*m.span(1), "@"))
            edits += [(x.start() + m.start(2), x.end() + m.start(2), ".") for x in dot.finditer(m.group(2))]
            edits.append((*m.span(3), "."))
        if edits:
            tape.rewrite(edits)
            yield tape


def _in_number(text: str, m: re.Match) -> bool:
    """A spelled digit counts beside another one or a digit, so that a lone
    "one" in prose stays a word."""
    joined = m.group()[-1] in " -"
    return bool(joined or _BEFORE.search(text[max(0, m.start() - _REACH):m.start()]) or re.match(r"[\x20-]?[0-9]", text[m.end():m.end() + 2]))


def added(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source characters: those
    that no base span and no longer added span of their kind covers."""
    found = {(kind, *tape.source(lo, hi)) for tape in normalised(text) for kind, lo, hi in identifiers(tape.text)}.difference(base)
    if not found:
        return []
    out, kind, reached = [], None, -1
    # by kind and start, longer spans first: a span is covered exactly if one before it reaches its end
    for span in sorted([*found, *base], key=lambda x: (x[0], x[1], -x[2])):
        if span[0] != kind:
            kind, reached = span[0], -1
        if span[2] > reached and span in found:
            out.append(span)
        reached = max(reached, span[2])
    return _ordered(out)


def _line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _ordered(spans):
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _scan(batches):
    for b in batches:
        rows = []
        for t in b.column(1).to_pylist():
            base = identifiers(t or "")
            every = _ordered(base + added(t or "", base))
            n = [sum(x[0] == k for x in base) for k in KINDS]
            rows.append((*n, hashlib.sha256(_line(base).encode()).hexdigest(), _line(every), len(every) - len(base)))
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))], _FOUND)


_FOUND = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to doc_id, the number of base spans of each
    kind, the digest of the base spans, all spans as kind:start:end (code
    points, end exclusive) and n_added, the number of spans the rewriting
    added. One row per input row; null text gives zero spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans merge."""
    if not text:
        return text
    base = identifiers(text)
    spans = sorted((s, e, k) for k, s, e in base + added(text, base))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` redacted and ``n_chars`` (if present) counted
    anew; all columns keep their names, order and types."""
    where = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            clean = [redact_text(t) for t in b.column(where).to_pylist()]
            cols = list(b.columns)
            cols[where] = pa.array(clean, b.schema.field(where).type)
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in clean], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return docs.mapInArrow(run, docs.schema)
