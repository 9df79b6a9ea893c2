"""Work that scales: texts tokenised once, all folds fitted in the same passes,
characters counted in one pass."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probelab.functions import lexical as LX
from probelab.operators import sparse as SP
from probelab.operators import tfidf as TF
from probelab.operators import zeroshot as ZS

DOCS = "dataset string, row_id long, fold int, labels array<int>, text string"
COLUMNS = ["dataset", "held", "term", "tf", "df", "n_train", "rank"]


def documents(spark, n=60, k=3, classes=3, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        own = rng.randrange(classes)
        rows.append(("d", i, i % k, [own], " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randrange(12)) + [f"c{own}"] * rng.randrange(3))))
    return spark.createDataFrame(rows + [("e", 1, 0, [0], "aa"), ("e", 2, 1, [1], "aa bb"), ("e", 3, 2, [1], "")], DOCS)


def rows_of(df, columns):
    return sorted(tuple(r) for r in df.select(columns).collect())


@pytest.mark.parametrize("first", [1, 3, 1 << 30])
def test_terms_left_uncounted_cannot_be_in_the_vocabulary(spark, monkeypatch, first):
    docs = documents(spark).cache()
    want = rows_of(TF.vocabulary(TF.term_counts(docs), docs, 3, 6), COLUMNS)
    monkeypatch.setattr(TF, "FIRST_BUCKETS", first)     # 1: the first bound is too high and is lowered
    codes = TF.coded(docs, "labels")
    assert rows_of(TF.frequent_vocabulary(codes, 3, 6), COLUMNS) == want and len(want) > 18
    assert "regexp" not in codes._jdf.queryExecution().executedPlan().toString()


def test_blocks_give_the_predictions_of_the_vectors(spark, monkeypatch):
    docs = documents(spark).withColumn("labels", F.when(F.col("row_id") == 7, F.array(F.lit(0), F.lit(2))).otherwise(F.col("labels")))
    docs = docs.unionByName(docs.where("row_id = 5")).cache()
    codes = TF.coded(docs, "labels")
    vocab = TF.frequent_vocabulary(codes, 3, 20).cache()
    columns = ["dataset", "held", "row_id", "label", "pred"]
    got = rows_of(SP.predictions(*TF.blocks(codes, vocab, 3)), columns)
    labels = docs.select("dataset", "row_id", "fold", F.explode("labels").alias("label")).distinct().drop("fold")
    vectors = TF.vectors(docs, vocab, 3).join(labels, ["dataset", "row_id"])
    assert got == rows_of(TF.vector_predictions(vectors, cap=20), columns)
    assert len(got) == 60 + 1 + 1 + 3
    monkeypatch.setattr(SP, "START_ROWS", 1)            # first weights from a part of the rows
    assert got == rows_of(SP.predictions(*TF.blocks(codes, vocab, 3)), columns)


def test_classes_without_training_rows_are_not_predicted(spark):
    # class 2 lies in fold 0 alone; fold 1's training rows of dataset e are of one class
    rows = [("d", i, i % 2, [2 if i == 4 else i // 2 % 2], f"c{i // 2 % 2} x{i}x") for i in range(40)] + [("e", 1, 0, [1], "aa"), ("e", 2, 1, [0], "aa")]
    codes = TF.coded(spark.createDataFrame(rows, DOCS), "labels")
    got = {(r.dataset, r.row_id): r.pred for r in SP.predictions(*TF.blocks(codes, TF.frequent_vocabulary(codes, 2, 30), 2)).collect()}
    assert all(got["d", i] == i // 2 % 2 for i in range(40))
    assert got["e", 1] == 0 and got["e", 2] == 1


def test_all_folds_share_a_pass(spark, monkeypatch):
    codes = TF.coded(documents(spark).where("dataset = 'd'"), "labels")
    vocab = TF.frequent_vocabulary(codes, 3, 20)
    passes = []
    own = SP._pass
    monkeypatch.setattr(SP, "_pass", lambda *a: passes.append(sum(len(f) for f in a[2].values())) or own(*a))
    n = SP.predictions(*TF.blocks(codes, vocab, 3)).count()
    assert n == 60 and passes[0] == 3 and len(passes) < 60


def test_weights_are_the_minimum(spark):
    rng = np.random.default_rng(3)
    n, d = 90, 5
    x, y = rng.random((n, d)), rng.integers(0, 3, n)
    counts = np.bincount(y).astype(float)
    fit = SP._Fit(counts, (x * x).sum(axis=0), 1.0)
    steps = 0
    while fit.open and steps < 200:
        e = x @ fit.tried[:, :-1].T + fit.tried[:, -1]
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = p - np.eye(3)[y]
        fit.take(-np.log(p[np.arange(n), y]).sum(), np.concatenate([r.T @ x, r.sum(axis=0)[:, None]], axis=1), 1e-12)
        steps += 1
    assert np.abs(fit.grad).max() < 1e-4 and steps < 100


def test_characters_are_counted_in_one_pass():
    texts = pa.array(["skipped", "", "Été à l’été", None, "a b  c", "e" * 5000], pa.string())
    chars = [" ", "a", "e", "é", "’", "𝄞"]
    for column in (texts[1:], texts[1:].cast(pa.large_string()), texts[:0]):
        want = [[(t or "").count(c) for c in chars] for t in column.to_pylist()]
        assert LX._counted(column, chars).tolist() == want


def test_option_scores_follow_the_character_rule(spark):
    cfg = spark.createDataFrame([("d", "?", 0, "x", "Aé"), ("d", "?", 1, "y", "bb c"), ("d", "?", 2, "z", "Aé"), ("e", "?", 0, "x", "q")], ZS.ZS_SCHEMA)
    texts = ["", "Aé bbb", "c c c", "é" * 9, None]
    rows = [("d", i, "x", t) for i, t in enumerate(texts)] + [("e", 9, "x", "qq"), ("f", 1, "x", "no options")]
    df = ZS.option_scores(spark.createDataFrame(rows, "dataset string, row_id long, label_text string, text string"), cfg)
    assert "replace(" not in df._jdf.queryExecution().optimizedPlan().toString()      # a pass over the text for each character

    def score(text, word):
        means = [sum(math.log(1 + text.count(c)) for c in w) / len(w) for w in (word, " " + word)]
        return math.log(sum(math.exp(m) for m in means))

    got = {(r.dataset, r.row_id): r.scores for r in df.collect()}
    assert sorted(got) == [("d", i) for i in range(5)] + [("e", 9)]
    for i, t in enumerate(texts[:4]):
        assert got["d", i] == pytest.approx([score(t, "Aé"), score(t, "bb c")])
    assert got["d", 4] == [None, None] and got["e", 9] == pytest.approx([score("qq", "q")])
