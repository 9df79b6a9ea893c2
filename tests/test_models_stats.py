"""M1-M3, A11-A13, A16-A19 against plain NumPy statements of the same math."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelab.functions.scalar import corr_pvalue, normal_two_sided
from probelab.operators import evaluate as EV
from probelab.operators import metrics as M
from probelab.operators import stats as ST


def _newton(Z, yi, K, C=1.0):
    """Plain NumPy statement of M2: full Newton steps, halved until the
    objective falls; the weights of one class (two classes) or of each."""
    A = np.hstack([Z, np.ones((len(Z), 1))])
    p, q = A.shape[1], 1 if K == 2 else K
    pen = np.tile(np.r_[np.full(p - 1, 1.0 / C), 0.0 if q == 1 else 1e-9], q)
    hot = np.eye(K)[yi]

    def terms(w):
        e = A @ w.reshape(q, p).T
        if q == 1:
            e = np.hstack([np.zeros_like(e), e])
        top = e.max(axis=1, keepdims=True)
        P = np.exp(e - top)
        norm = P.sum(axis=1, keepdims=True)
        f = float((np.log(norm[:, 0]) + top[:, 0] - (e * hot).sum(axis=1)).sum()) + 0.5 * float(pen @ (w * w))
        P = P / norm
        keep = [1] if q == 1 else range(K)
        g = np.concatenate([A.T @ (P[:, c] - hot[:, c]) for c in keep]) + pen * w
        H = np.block([[(A.T * (P[:, c] * ((c == e2) - P[:, e2]))) @ A for e2 in keep] for c in keep]) + np.diag(pen)
        return f, g, H

    w = np.zeros(p * q)
    for _ in range(60):
        f, g, H = terms(w)
        step, t = np.linalg.solve(H, g), 1.0
        while terms(w - t * step)[0] > f and t > 1e-8:
            t /= 2
        w = w - t * step
        if np.max(np.abs(t * step)) < 1e-11:
            break
    return w.reshape(q, p)


def _newton_predict(w, Z, K):
    e = np.hstack([Z, np.ones((len(Z), 1))]) @ w.T
    return (e[:, 0] > 0).astype(int) if K == 2 else e.argmax(axis=1)


def _scaled(X, train):
    sd = X[train].std(axis=0)
    return (X - X[train].mean(axis=0)) / np.where(sd > 1e-12, sd, 1.0)


def _matrix(spark, n=240, d=6, K=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, K, n)
    X = rng.normal(size=(n, d))
    X[:, 1] += 0.8 * y
    X[:, 5] = 2.0                      # constant column
    rows = [("d", i, int(y[i]), int(i % 5), [float(v) for v in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, row_id long, label int, fold int, x array<double>"), X, y


CONFIGS = [("a", "d", [0, 1]), ("b", "d", [1, 2, 3, 5]), ("c", "d", [5]), ("all", "d", [0, 1, 2, 3, 4, 5])]


def _counts(df):
    return {(r.config_id, r.fold, r.label, r.pred): r.n for r in df.collect()}


@pytest.mark.parametrize("K", [2, 3, 6])
def test_weights_and_predictions_equal_numpy(spark, K):
    m, X, y = _matrix(spark, K=K, seed=K)
    prep = EV.prepare(m)
    oof, weights = EV.fit_and_predict(prep, CONFIGS, output="oof")
    got = {(r.config_id, r.row_id): r.pred for r in oof.collect()}
    assert len(got) == len(CONFIGS) * len(y)
    fold = np.arange(len(y)) % 5
    for name, _, cols in CONFIGS:
        for held in range(5):
            Z = _scaled(X[:, cols], fold != held)
            w = _newton(Z[fold != held], y[fold != held], K)
            mine = weights[name, held][:, [*cols, X.shape[1]]].copy()
            if K > 2:                       # a shift of all intercepts is no difference
                mine[:, -1] -= mine[:, -1].mean()
                w[:, -1] -= w[:, -1].mean()
            assert np.allclose(mine, w, atol=1e-6)
            at = np.flatnonzero(fold == held)
            e = np.sort(np.c_[np.zeros(len(at)), np.c_[Z[at], np.ones(len(at))] @ w.T][:, 0 if K == 2 else 1:], axis=1)
            clear = e[:, -1] - e[:, -2] > 1e-6          # equal scores may go either way in NumPy
            assert (np.array([got[name, i] for i in at]) == _newton_predict(w, Z[at], K))[clear].all()
    prep.release()


def test_partitions_and_state_bound_change_nothing(spark, monkeypatch):
    """The same fits over 1 and 13 partitions, and one fit at a time with one
    fit a vector and one row a score table."""
    m, X, y = _matrix(spark, K=4, seed=11)
    cfg = EV.config_frame(spark, CONFIGS)
    want = _counts(EV.evaluate_many(m.repartition(1), cfg))
    assert sum(n for (c, *_), n in want.items() if c == "a") == len(y)
    assert _counts(EV.evaluate_many(m.repartition(13), cfg)) == want
    monkeypatch.setattr(EV, "SLICE_VALUES", 1)
    monkeypatch.setattr(EV, "SCORE_VALUES", 1)
    one = EV.config_frame(spark, CONFIGS[:1])
    assert _counts(EV.evaluate_many(m, one, state_bytes=1)) == {k: n for k, n in want.items() if k[0] == "a"}


def test_warm_start_reaches_the_same_weights(spark):
    prep = EV.prepare(_matrix(spark, seed=4)[0])
    _, small = EV.fit_and_predict(prep, [("s", "d", [0, 1])])
    more = [("t", "d", [0, 1, 3])]
    _, cold = EV.fit_and_predict(prep, more)
    _, warm = EV.fit_and_predict(prep, more, start={("t", h): w for (_, h), w in small.items()})
    assert all(np.allclose(cold[k], warm[k], atol=1e-6) for k in cold)
    prep.release()


def test_edge_matrices(spark):
    schema = "dataset string, row_id long, label int, fold int, x array<double>"
    cfg = EV.config_frame(spark, [("a", "d", [0]), ("z", "absent", [0])])
    empty = spark.createDataFrame([], schema)
    assert EV.evaluate_many(empty, cfg).count() == 0
    assert EV.evaluate_many(empty, cfg, output="oof").count() == 0
    # one class: always predicted; rows that no model can use are left out
    rows = [("d", i, 7, i % 5, [float(i), 1.0]) for i in range(10)]
    bad = [("d", 100, None, 0, [1.0, 1.0]), ("d", 101, 7, None, [1.0, 1.0]), ("d", 102, 7, 0, None),
           ("d", 103, 7, 0, [None, 1.0]), ("d", 104, 7, 0, [float("nan"), 1.0])]
    got = EV.evaluate_many(spark.createDataFrame(rows + bad, schema), cfg, output="oof").collect()
    assert sorted((r.row_id, r.pred) for r in got) == [(i, 7) for i in range(10)]
    # a class that only the held fold has is not predicted, and nothing breaks
    only = rows + [("d", 50 + i, 8, 0, [float(i), 2.0]) for i in range(3)]
    got = EV.evaluate_many(spark.createDataFrame(only, schema), cfg, output="oof").collect()
    assert all(r.pred == 7 for r in got if r.fold == 0) and len(got) == 13
    with pytest.raises(ValueError):
        EV.evaluate_many(empty, cfg, classifier="forest")


def test_greedy_forward_equals_brute_force(spark):
    from probelab.operators import selection as SEL
    m, X, y = _matrix(spark, n=150, K=3, seed=8)
    got = SEL.greedy_forward(m, {("d", "S"): [0, 1, 2, 4], ("none", "S"): [0, 1]}, {i: f"q{i}" for i in range(6)})
    path = [(r.k, r.qid, round(r.acc, 12)) for r in got.orderBy("k").collect()]
    fold, chosen, rest, want = np.arange(len(y)) % 5, [], [0, 1, 2, 4], []

    def accuracy(cols):
        accs = []
        for held in range(5):
            Z = _scaled(X[:, cols], fold != held)
            w = _newton(Z[fold != held], y[fold != held], 3)
            accs.append(np.mean(_newton_predict(w, Z[fold == held], 3) == y[fold == held]))
        return round(float(np.mean(accs)), 12)

    while rest:
        best = max(rest, key=lambda j: (accuracy(chosen + [j]), -rest.index(j)))
        want.append((len(chosen) + 1, f"q{best}", accuracy(chosen + [best])))
        chosen.append(best)
        rest.remove(best)
    assert path == want


def test_mlp_runs(spark):
    m, X, y = _matrix(spark, n=150)
    cfg = EV.config_frame(spark, [("a", "d", [0, 1])])
    conf = EV.evaluate_many(m, cfg, classifier="mlp", mlp_kw={"max_iter": 50})
    acc = M.cv_accuracy(conf).first()
    assert 1 / 3 < acc.acc <= 1.0 and acc.n_folds == 5          # column 1 carries the class
    assert sum(r.n for r in conf.collect()) == 150


def _conf(spark, rows):
    return spark.createDataFrame(rows, "config_id string, fold int, label int, pred int, n long")


def test_fold_mean_not_pooled(spark):
    # folds of 100 and 99 rows: mean of fold accuracies
    c = _conf(spark, [("x", 0, 0, 0, 50), ("x", 0, 0, 1, 50), ("x", 1, 0, 0, 33), ("x", 1, 1, 0, 66)])
    r = M.cv_accuracy(c).first()
    assert abs(r.acc - (0.5 + 33 / 99) / 2) < 1e-12
    assert abs(r.acc_std - abs(0.5 - 33 / 99) / 2) < 1e-12


def test_macro_f1_class_never_predicted(spark):
    # labels 0,0,1,2 ; preds 0,0,0,2  -> f1: c0 = 2*2/(2+3)=.8, c1 = 0, c2 = 1
    c = _conf(spark, [("x", 0, 0, 0, 2), ("x", 0, 1, 0, 1), ("x", 0, 2, 2, 1)])
    assert abs(M.macro_f1(c).first().f1 - (0.8 + 0 + 1) / 3) < 1e-12


def test_macro_f1_class_only_predicted(spark):
    # label 0 twice; preds 0 and 3 -> classes {0,3}: f1 c0 = 2/3, c3 = 0
    c = _conf(spark, [("x", 0, 0, 0, 1), ("x", 0, 0, 3, 1)])
    assert abs(M.macro_f1(c).first().f1 - (2 / 3) / 2) < 1e-12


def test_histogram_zero_filled(spark):
    pred = spark.createDataFrame([("d", 0), ("d", 0), ("d", 2)], "dataset string, pred int")
    opts = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "dataset string, pred int")
    h = {r.pred: r.n for r in M.prediction_histogram(pred, opts).collect()}
    assert h == {0: 2, 1: 0, 2: 1}


def test_best_candidate_first_wins_ties(spark):
    s = spark.createDataFrame([("g", 3, 0.5), ("g", 1, 0.5), ("g", 2, 0.4)], "k string, col_idx int, acc double")
    assert M.best_candidate(s, ["k"]).first().col_idx == 1


def _ranks(v):
    v = np.asarray(v, float)
    order = v.argsort(kind="mergesort")
    r = np.empty(len(v))
    i = 0
    s = v[order]
    while i < len(v):
        j = i
        while j + 1 < len(v) and s[j + 1] == s[i]:
            j += 1
        r[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return r


def test_pearson_spearman_with_ties(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(40), 1)
    y = x + rng.normal(size=40) * 0.3
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    p = ST.pearson(df, ["g"], "x", "y").first()
    s = ST.spearman(df, ["g"], "x", "y").first()
    assert abs(p.r - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert abs(s.rho - np.corrcoef(_ranks(x), _ranks(y))[0, 1]) < 1e-12
    assert abs(p.p - corr_pvalue(p.r, 40)) < 1e-15


def test_mann_whitney_no_ties(spark):
    a = list(range(20))
    b = [x + 13.5 for x in range(20)]
    df = spark.createDataFrame([("t", float(v), "A") for v in a] + [("t", float(v), "B") for v in b],
                               "k string, v double, g string")
    r = ST.mann_whitney(df, ["k"], "v", "g", "A").first()
    ranks = _ranks(a + b)
    u1 = ranks[:20].sum() - 20 * 21 / 2
    assert r.u_first == u1 and r.u_second == 400 - u1


def test_ranks_of_one_key_over_many_ranges(spark):
    """Two keys and a null one, one with nearly all values: ranks equal NumPy's,
    and no range holds a large part of the key."""
    rng = np.random.default_rng(2)
    big = np.round(rng.normal(size=4000), 2)
    rows = [("a", float(v)) for v in big] + [("b", 1.0), ("b", 1.0), ("b", -3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ST.value_ranks(counts, ["k"], "v", "n").collect()
        dealt = counts.repartitionByRange("k", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    got = {(r.k, r.v): (r["rank"], r.total) for r in ranked}
    want = dict(zip(big.tolist(), _ranks(big)))
    assert all(got["a", v] == (r, 4000) for v, r in want.items())
    assert got["b", -3.0] == (1.0, 3) and got["b", 1.0] == (2.5, 3) and got[None, 5.0] == (1.0, 1)
    assert len(got) == len(want) + 3
    assert len(dealt) > 2 and max(r["count"] for r in dealt) < len(got) / 2


def test_rank_statistics_leave_nulls_out(spark):
    pairs = [("k", 1.0, 2.0), ("k", 2.0, 1.0), ("k", 3.0, 9.0), ("k", None, 5.0), ("k", 7.0, None), ("c", 1.0, 1.0),
             ("c", 1.0, 2.0), ("e", None, None)]
    df = spark.createDataFrame(pairs, "g string, x double, y double")
    got = {r.g: r for r in ST.spearman(df, ["g"], "x", "y").collect()}
    assert abs(got["k"].rho - 0.5) < 1e-12 and got["k"].n == 3
    assert got["c"].rho is None and got["c"].n == 2 and got["e"].rho is None and got["e"].n == 0
    m = spark.createDataFrame([("t", 1.0, "A"), ("t", 2.0, "B"), ("t", None, "A"), ("s", 1.0, "A"), ("s", 1.0, "B")],
                              "k string, v double, g string")
    res = {r.k: r for r in ST.mann_whitney(m, ["k"], "v", "g", "A").collect()}
    assert res["t"].u_first == 0 and res["t"].u_second == 1 and res["s"].z is None and res["s"].p == 1
    assert ST.spearman(df.where("false"), ["g"], "x", "y").count() == 0


def test_linear_fit_grid(spark):
    df = spark.createDataFrame([("k", float(x), 2.0 * x + 1) for x in range(10)], "g string, x double, y double")
    fit, pts = ST.linear_fit(df, ["g"], "x", "y")
    f = fit.first()
    assert abs(f.slope - 2) < 1e-12 and abs(f.intercept - 1) < 1e-12
    assert pts.count() == 50
    assert abs(pts.filter("i = 49").first().y - 19.0) < 1e-9


# Golden statistics of the published analysis (FIXTURES.md section 2): the
# p-value functions must reproduce them from r / U and n.
def test_golden_p_values():
    assert abs(corr_pvalue(0.559977068784898, 40) - 1.7180345556649674e-4) < 1e-12
    assert abs(corr_pvalue(0.5893026146989084, 40) - 6.312172517675633e-5) < 1e-13
    assert abs(corr_pvalue(0.4890864281532579, 40) - 1.3622432374137293e-3) < 1e-11
    assert abs(corr_pvalue(0.5215759849906193, 40) - 5.577577836175676e-4) < 1e-12
    n1 = n2 = 20
    sigma = math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1))
    z = (330 - n1 * n2 / 2 - 0.5) / sigma
    assert abs(normal_two_sided(z) - 4.600727270090418e-4) < 1e-12


@pytest.mark.parametrize("K", [2, 3])
def test_tfidf_classifier_predicts_every_document(spark, K):
    from probelab.operators import tfidf as TF
    rng = np.random.default_rng(10 + K)
    n, D = 60, 8
    dense = rng.random((n, D)) * (rng.random((n, D)) < 0.4)
    y = rng.integers(0, K, n)
    dense[np.arange(n), y] += 0.8
    dense[[3, 17]] = 0                      # documents without a kept term
    w = spark.createDataFrame([("d", h, int(i), int(c), float(dense[i, c])) for h in range(2) for i, c in zip(*np.nonzero(dense))],
                              "dataset string, held int, row_id long, col int, weight double")
    docs = spark.createDataFrame([("d", i, i % 2, int(y[i])) for i in range(n)], "dataset string, row_id long, fold int, label int")
    got = {r.row_id: r for r in TF.cv_predictions(w, docs, cap=D, k=2).collect()}
    assert sorted(got) == list(range(n))
    for h in range(2):
        train, held = np.arange(n) % 2 != h, np.flatnonzero(np.arange(n) % 2 == h)
        want = _newton_predict(_newton(dense[train], y[train], K), dense[held], K)
        assert [got[i].pred for i in held] == want.tolist()
        assert all(got[i].held == h and got[i].label == y[i] for i in held)


def test_acc_output_equals_confusion_metrics(spark):
    m, X, y = _matrix(spark, seed=7)
    cfg = EV.config_frame(spark, [("a", "d", [0, 1]), ("b", "d", [1, 2, 3])])
    direct = {r.config_id: tuple(r) for r in EV.evaluate_many(m, cfg, output="acc").collect()}
    via = {r.config_id: tuple(r) for r in M.cv_accuracy(EV.evaluate_many(m, cfg)).collect()}
    assert direct == via and set(via) == {"a", "b"}
