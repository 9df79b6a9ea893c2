"""Work that scales: terms counted in their own task, rows dealt over all cores."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelab.operators import tfidf as TF

DOCS = "dataset string, row_id long, fold int, text string"


def plain_counts(text):
    words = re.findall(r"\w{2,}", text.lower())
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def test_tfidf_vectors_equal_plain_statement(spark, monkeypatch):
    texts = ["b1 aa bb aa bb", "aa cc x dd", "", "bb", "aa aa aa cc", "dd ee ff aa bb", "zz"]
    docs = spark.createDataFrame([("d", i, i % 2, t) for i, t in enumerate(texts)] + [("e", 1, 0, "aa"), ("e", 2, 1, "aa")], DOCS)
    monkeypatch.setattr(TF, "BATCH_TOKENS", 3)
    monkeypatch.setattr(TF, "COMBINE_ROWS", 2)
    cap = 4
    vocab = TF.vocabulary(TF.term_counts(docs), docs, k=2, cap=cap).cache()
    got = {(r.held, r.row_id): r for r in TF.vectors(docs, vocab, 2).where("dataset = 'd'").collect()}
    assert len(got) == 2 * len(texts)
    for held in range(2):
        train = [plain_counts(t) for i, t in enumerate(texts) if i % 2 != held]
        total, df = sum(train, Counter()), Counter(t for c in train for t in c)
        top = sorted(total, key=lambda t: (-total[t], t))[:cap]
        assert [r.term for r in vocab.where(f"dataset = 'd' and held = {held}").orderBy("rank").collect()] == top
        for i, text in enumerate(texts):
            c = plain_counts(text)
            want = {j: (1 + math.log(c[t])) * (math.log((1 + len(train)) / (1 + df[t])) + 1) for j, t in enumerate(top) if c[t]}
            norm = math.sqrt(sum(w * w for w in want.values()))
            assert got[held, i].cols == sorted(want)
            assert got[held, i].vals == pytest.approx([want[j] / norm for j in sorted(want)])
    long = {(r.held, r.row_id, r.term): r.weight for r in TF.weights(docs, vocab, 2).where("dataset = 'd'").collect()}
    assert len(long) == sum(len(r.cols) for r in got.values())
    n = {(r.row_id, r.term): r.tf for r in TF.doc_term_counts(docs).where("dataset = 'd'").collect()}
    assert n == {(i, t): c for i, text in enumerate(texts) for t, c in plain_counts(text).items()}


def test_repeated_keys_are_normalised_together(spark):
    docs = spark.createDataFrame([("d", 1, 0, "aa bb"), ("d", 1, 0, "aa bb"), ("d", 2, 1, "aa bb")], DOCS)
    vocab = TF.vocabulary(TF.term_counts(docs), docs, k=2)
    norms = (TF.weights(docs, vocab, 2).where("row_id = 1").groupBy("held").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    assert [r.s for r in norms] == pytest.approx([1.0] * len(norms)) and norms


def test_documents_are_not_shuffled_for_their_weights(spark):
    docs = spark.createDataFrame([("d", 1, 0, "aa bb"), ("d", 2, 1, "aa bb")], DOCS)
    plan = TF.vectors(docs, TF.vocabulary(TF.term_counts(docs), docs, k=2), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def documents(spark, folder):
    rows = [(1, "a <br/> yes  No", "en", "s", 1), (2, None, "en", "s", 1), (3, " <br> ", "de", "s", 1), (None, "noes", "fr", "s", 1),
            (1, "a <br/> yes  No", "en", "s", 1), (4, "Sey yes", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_are_dealt_before_they_are_cleaned(spark, tmp_path):
    from probelab.plans import queries as Q
    sf = documents(spark, tmp_path)
    assert sorted(r.text for r in Q._texts(spark, sf).collect()) == ["Sey yes", "a yes No", "a yes No", "noes"]
    for df in (Q._texts(spark, sf), Q.prompts_q(spark, sf), Q.prob_diff(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        above, _, below = plan.partition("Exchange ")
        assert "regexp_replace" in above and "regexp_replace" not in below and "Exchange " not in below


def test_spaces_are_counted_below_the_generator(spark, tmp_path):
    from probelab.plans import queries as Q
    prompts = Q.prompts_q(spark, documents(spark, tmp_path))
    plan = prompts._jdf.queryExecution().executedPlan().toString()
    assert "replace(text" not in plan[:plan.index("Generate explode([[")]
    rows = prompts.collect()
    assert len(rows) == 4 * 50 and all(r.prompt_len == len(r.prompt.split(" ")) for r in rows)
