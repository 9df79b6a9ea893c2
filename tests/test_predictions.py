"""Nearest-centroid predictions, the character scorer and rank tests of
constant values against plain statements of the same rules."""

import math

import numpy as np
import pyarrow as pa
import pytest

from probelab.functions.lexical import LexicalScorer
from probelab.operators import centroid as CE
from probelab.operators import features as FE
from probelab.operators import scoring as S
from probelab.operators import stats as ST
from probelab.sources import catalog as C

MATRIX = "dataset string, row_id long, label int, fold int, x array<double>"


def brute(rows, cols, k=5):
    """Plain nearest centroids of one dataset's rows (row_id, label, fold, x)."""
    x = np.floor(np.array([r[3] for r in rows]) * 1e6 + 0.5)
    y, fold, out = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), {}
    for held in range(k):
        train = fold != held
        if not train.any():
            continue
        sd = x[train].std(axis=0)
        sd[np.ptp(x[train], axis=0) == 0] = 1
        classes = sorted(set(y[train]))
        centre = np.array([x[train & (y == c)].mean(axis=0) for c in classes])
        for i in np.flatnonzero(fold == held):
            d = (((x[i] - centre) / sd)[:, cols] ** 2).sum(axis=1)
            out[rows[i][0]] = classes[int(np.argmin(d))]
    return out


def test_predictions_match_plain_centroids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), int(rng.integers(5)), (rng.standard_normal(6) + (i % 3) * np.array([1, 0, .5, 0, 0, 0])).tolist()) for i in range(120)]
    for r in rows:
        r[3][4] = 2.5                       # a constant element
    rows += [(200, 7, 0, [9.0] * 4 + [2.5, 9.0])]       # a class that only its own fold knows
    other = [(i, int(i % 2), int(i % 5), [float(i % 2)] * 6) for i in range(20)]
    m = spark.createDataFrame([("a", *r) for r in rows] + [("b", *r) for r in other] + [("c", 1, 0, 0, [1.0] * 6)], MATRIX)
    configs = [("all", "a", [0, 1, 2, 3, 4, 5]), ("one", "a", [2]), ("flat", "a", [4]), ("b", "b", [0, 1])]
    got = {}
    for r in CE.predictions(m, configs).collect():
        got.setdefault(r.config_id, {})[r.row_id] = r.pred
    assert got["all"] == brute(rows, [0, 1, 2, 3, 4, 5]) and got["one"] == brute(rows, [2])
    assert set(got["flat"].values()) == {0}             # equally near: the smallest label
    assert got["b"] == {i: i % 2 for i in range(20)}
    assert set(got) == {"all", "one", "flat", "b"}


def test_predictions_of_nulls_and_empty(spark):
    assert CE.predictions(spark.createDataFrame([], MATRIX), [("x", "a", [0])]).count() == 0
    rows = [("a", i, i % 2, i % 5, [float(i % 2), None if i < 3 else 1.0]) for i in range(30)]
    got = {r.row_id: r.pred for r in CE.predictions(spark.createDataFrame(rows, MATRIX), [("x", "a", [0, 1])]).collect()}
    assert got == {i: i % 2 for i in range(30)}
    alone = spark.createDataFrame([("a", i, 0, 0, [1.0]) for i in range(3)], MATRIX)     # one fold holds all rows
    assert CE.predictions(alone, [("x", "a", [0])]).count() == 0


def plain_logit(text, question, token):
    return sum((1 + question.count(c)) * math.log(1 + text.count(c)) for c in token) / len(token)


def test_character_scorer(spark):
    texts = ["Yes, no. NOSEY eyes on one", "", "x" * 50, "no no no"]
    cat = C.catalogue(spark).limit(4)
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset string, row_id long, text string")
    variants = S.variant_rows(S.ANSWERS)
    questions = {r.qid: r.question for r in cat.collect()}
    for r in S.answer_logits(df, cat).collect():
        for answer in ("yes", "no"):
            want = [plain_logit(texts[r.row_id], questions[r.qid], t) for a, t, _ in variants if a == answer]
            assert r[answer] == pytest.approx(want, abs=1e-12)
    wide = {r.row_id: r.x for r in S.probe_arrays(df, cat).collect()}
    for r in S.feature_from_arrays(S.answer_logits(df, cat)).collect():
        assert r.value == pytest.approx(wide[r.row_id][list(questions).index(r.qid)], abs=1e-12)
    long = {(r.row_id, r.qid): r.value for r in S.feature_from_logits(S.long_logits(S.answer_logits(df, cat))).collect()}
    assert len(long) == 16 and long[0, list(questions)[0]] == pytest.approx(wide[0][0], abs=1e-12)
    prompts = S.prompts(df, cat).orderBy("row_id", "qid").toPandas()
    tokens = [t for _, t, _ in variants]
    got = LexicalScorer()(pa.RecordBatch.from_pandas(prompts), tokens)
    for i, r in prompts.iterrows():
        assert got[i] == pytest.approx([plain_logit(texts[r.row_id], questions[r.qid], t) for t in tokens], abs=1e-12)


def test_every_element_has_an_id(spark):
    emb = spark.createDataFrame([(1, [0.5, 1.5, 2.5]), (2, [3.5])], "vec_id long, embedding array<float>")
    assert FE.element_ids(["a", "b"], FE.width_of(emb)) == ["a", "b", "element_3"]
    assert {(r.row_id, r.qid, r.value) for r in FE.embeddings_long(emb, ["a", "b"]).collect()} == {(1, "a", 0.5), (1, "b", 1.5), (1, "element_3", 2.5), (2, "a", 3.5)}


def test_rank_test_of_constant_values(spark):
    df = spark.createDataFrame([("t", 1.0, "A"), ("t", 1.0, "B"), ("t", 1.0, "B"), ("one", 2.0, "A")], "k string, v double, g string")
    got = {r.k: r for r in ST.mann_whitney(df, ["k"], "v", "g", "A").collect()}
    assert got["t"].z is None and got["t"].p == 1.0 and got["t"].u_first == 1.0
    assert got["one"].z is None and got["one"].p == 1.0
    flat = spark.createDataFrame([("c", float(i), 1.0) for i in range(5)] + [("two", 0.0, 1.0), ("two", 1.0, 3.0)], "k string, x double, y double")
    r = {x.k: x for x in ST.pearson(flat, ["k"], "x", "y").collect()}
    rho = {x.k: x for x in ST.spearman(flat, ["k"], "x", "y").collect()}
    assert rho["c"].rho is None and rho["c"].p is None and rho["two"].rho == pytest.approx(1)
    fit = {x.k: x for x in ST.linear_fit(flat, ["k"], "y", "x")[0].collect()}
    assert fit["c"].slope is None and fit["two"].slope == pytest.approx(0.5)
    assert r["c"].r is None and r["c"].p is None and r["two"].r == pytest.approx(1) and r["two"].p is None
