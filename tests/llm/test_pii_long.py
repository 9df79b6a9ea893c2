"""Deobfuscation of texts with very many disguised identifiers, and the
stretch-wise tape against one that keeps a range for every character."""

import random
import time

from probelab.llm import pii


class CharacterTape:
    """The plain statement: the source range of each character."""

    def __init__(self, text):
        self.text, self.ranges = text, [(i, i + 1) for i in range(len(text))]

    def rewrite(self, edits):
        text, ranges, at = [], [], 0
        for lo, hi, new in edits:
            text += [self.text[at:lo], new]
            ranges += self.ranges[at:lo] + [(self.ranges[lo][0], self.ranges[hi - 1][1])] * len(new)
            at = hi
        self.text, self.ranges = "".join(text) + self.text[at:], ranges + self.ranges[at:]

    def source(self, lo, hi):
        return self.ranges[lo][0], self.ranges[hi - 1][1]


def test_tape_equals_character_ranges():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("abc @.", k=rng.randint(1, 60)))
        tape, plain = pii.Tape(text), CharacterTape(text)
        for _ in range(rng.randint(0, 4)):
            n, edits, at = len(tape.text), [], 0
            while at < n and rng.random() < 0.8:
                lo = rng.randint(at, n - 1)
                hi = rng.randint(lo + 1, min(n, lo + 5))
                edits.append((lo, hi, rng.choice(["", "x", "long"])))
                at = hi
            tape.rewrite(edits)
            plain.rewrite(edits)
        assert tape.text == plain.text
        for _ in range(20):
            if tape.text:
                lo = rng.randint(0, len(tape.text) - 1)
                hi = rng.randint(lo + 1, len(tape.text))
                assert tape.source(lo, hi) == plain.source(lo, hi)


def test_added_spans_are_the_uncovered_ones():
    rng = random.Random(9)
    parts = ["jоhn@site.org", "a [at] b [dot] org", "+44 20 7946 095 eight", "one two three four", "​", "4111 1111 1111 1111",
             "41​11 1111 1111 1111", "10.0.0.1", "１0.０.0.1", "x@y.z", "joe arroba casa punto es", "р@р.ru", " und "]
    for _ in range(200):
        text = " ".join(rng.choices(parts, k=rng.randint(1, 20)))
        base = pii.identifiers(text)
        found = {(k, *t.source(lo, hi)) for t in pii.normalised(text) for k, lo, hi in pii.identifiers(t.text)}
        covers = lambda x, y: x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2]
        want = [x for x in found if x not in base and not any(covers(b, x) for b in base) and not any(covers(y, x) and y != x for y in found)]
        assert pii.added(text, base) == pii._ordered(want)


def test_time_follows_the_length():
    def seconds(n):
        text, began = "joe [at] site [dot] org " * n, time.process_time()
        assert len(pii.added(text, pii.identifiers(text))) == n
        return time.process_time() - began
    small = seconds(10_000)
    assert seconds(80_000) < 8 * small * 2.5 + 0.5
