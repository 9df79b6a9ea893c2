"""Report composition (M16, M17, J7, R3, S7, S10), sinks and the stream form of scoring."""

import os
import tempfile

import numpy as np

from pyspark.sql import functions as F

from conftest import SMOKE
from probelab.operators import features as FE
from probelab.operators import scoring as S
from probelab.plans import report as RP
from probelab.sources import catalog as C
from probelab.sources import sinks as SK
from probelab.sources.tables import read_table
from probelab.streaming import scoring_stream as SS


def test_analysis_and_report(spark):
    emb = read_table(spark, SMOKE, "embeddings")
    qids = [r[1] for r in C.default_rows()]
    long = FE.embeddings_long(emb, qids)
    labelled = FE.embeddings_labels(emb)
    res = RP.analyse(long, labelled, C.catalogue(spark), greedy=False, n_perm=2)
    assert res["groups"].count() == 4
    assert res["uni"].count() == 50
    assert res["per_question"].count() == 40
    assert res["random_band"].count() == 20
    ov = RP.overall(res["per_question"], res["control"])
    c = ov["correlations"].first()
    assert -1 <= c.r <= 1 and 0 <= c.p <= 1
    assert ov["fit_line"].count() == 50
    assert ov["mann_whitney"].first().u_first + ov["mann_whitney"].first().u_second == 400
    tree = RP.results_tree(res)
    out = tempfile.mkdtemp(dir="/tmp")
    SK.write_json(tree, os.path.join(out, "results"))
    back = spark.read.json(os.path.join(out, "results")).first()
    assert back.dataset == "embeddings" and len(back.uni.asDict()) == 50
    charts = RP.chart_tables(res)
    assert charts["sense_matrix"].count() == 1
    SK.write_csv(res["per_question"], os.path.join(out, "per_question"))
    assert spark.read.option("header", True).csv(os.path.join(out, "per_question")).count() == 40


def test_stream_scoring_matches_batch(spark):
    root = tempfile.mkdtemp(dir="/tmp")
    src = os.path.join(root, "in")
    texts = spark.createDataFrame([("d", i, f"some text {i}") for i in range(20)],
                                  "dataset string, row_id long, text string")
    texts.write.parquet(src)
    cat = C.catalogue(spark).limit(5)
    q = SS.score_stream(spark, SS.texts_stream(spark, src, texts.schema), cat,
                        os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    got = {(r.row_id, r.qid): r.value for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    want = {(r.row_id, r.qid): r.value for r in S.feature_from_arrays(S.answer_logits(texts, cat)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9
    # a rerun with no new files adds nothing
    q2 = SS.score_stream(spark, SS.texts_stream(spark, src, texts.schema), cat,
                         os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q2.awaitTermination(300)
    assert spark.read.parquet(os.path.join(root, "out")).count() == 100


def test_stream_and_batch_runs_share_one_store(spark):
    """A batch run, a stream with repeated and new rows, a longer catalogue and
    a micro-batch that runs again: no key twice, and the values of one run."""
    root = tempfile.mkdtemp(dir="/tmp")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    schema = "dataset string, row_id long, text string"
    texts = spark.createDataFrame([("1", i, f"some text {i}") for i in range(12)] + [("1", None, "no id")], schema)
    few, cat = C.catalogue(spark).limit(3), C.catalogue(spark).limit(5)
    S.run_missing(texts.where("row_id < 4"), few, out)
    texts.where("row_id < 9").unionAll(texts.where("row_id = 2")).write.parquet(src)
    stream = SS.score_stream(spark, SS.texts_stream(spark, src, texts.schema), cat, out, os.path.join(root, "c1"))
    stream.awaitTermination(300)
    # another checkpoint knows no file: every micro-batch runs again
    again = SS.score_stream(spark, SS.texts_stream(spark, src, texts.schema), cat, out, os.path.join(root, "c2"))
    again.awaitTermination(300)
    S.run_missing(texts.where("row_id is not null"), cat, out)
    rows = spark.read.schema(S.FEATURE_SCHEMA).parquet(out).collect()
    assert len(rows) == len({(r.row_id, r.qid) for r in rows}) == 12 * 5
    want = {(r.row_id, r.qid): r.value for r in S.feature_from_arrays(S.answer_logits(texts, cat)).collect()}
    assert max(abs(r.value - want[r.row_id, r.qid]) for r in rows) < 1e-9


def test_prompts_leave_out_what_is_done(spark):
    texts = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("e", None, "x")],
                                  "dataset string, row_id long, text string")
    cat = C.catalogue(spark).limit(4)
    qids = [r.qid for r in cat.collect()]
    done = spark.createDataFrame([("d", 1, q) for q in qids] + [("d", 2, qids[1]), ("d", 2, qids[1]), ("d", 9, qids[0]),
                                                                 ("e", None, qids[0]), ("d", 2, "other")],
                                 "dataset string, row_id long, qid string")
    key = lambda df: sorted((r.dataset, str(r.row_id), r.qid, r.prompt, r.prompt_len) for r in df.collect())
    full = S.prompts(texts, cat)
    left = key(S.prompts(texts, cat, done))
    assert left == key(S.pending(full, done))
    assert sum(1 for r in left if r[1] == "2") == 3 and not any(r[1] == "1" for r in left)
    assert key(S.prompts(texts, cat, done.where("false"))) == key(full)


def test_long_logits_of_many_tokens(spark):
    """States of bins against NumPy: wide ranges, one answer missing, logits
    without mass, a prompt over many partitions."""
    rng = np.random.default_rng(0)
    wide = rng.normal(size=3000) * 200
    rows = [("d", 1, "q", ("yes", "no", "other")[i % 3], f"t{i:04d}", float(v)) for i, v in enumerate(wide)]
    rows += [("d", 2, "q", "yes", "a", 800.0), ("d", 2, "q", "no", "b", 799.0), ("d", 2, "q", "other", "c", 801.0),
             ("d", 2, "q", "no", "x", None), ("d", 2, "q", "no", "y", float("nan")), ("d", 2, "q", "no", "z", float("-inf")),
             ("d", 3, "q", "yes", "a", 0.5)]
    df = spark.createDataFrame(rows, "dataset string, row_id long, qid string, answer string, token string, logit double").repartition(7)
    lse = lambda v: v.max() + np.log(np.exp(v - v.max()).sum())
    got = {r.row_id: r.lse for r in S.log_masses(df, ["yes", "no"]).collect()}
    assert np.allclose(got[1], [lse(wide[0::3]), lse(wide[1::3]), lse(wide)], rtol=1e-13)
    assert np.allclose(got[2], [800, 799, lse(np.array([800.0, 799, 801]))]) and got[3][1] is None
    full = {r.row_id: r.value for r in S.feature_from_logits(df, mode="full").collect()}
    e = np.exp([-1.0, -2.0, 0.0])
    assert abs(full[2] - (e[0] - e[1]) / e.sum()) < 1e-12 and full[3] is None
    top = [r for r in S.top_tokens(df.where("row_id = 1"), 3).orderBy("rank").collect()]
    order = np.argsort(-wide)[:3]
    assert [r.token for r in top] == [f"t{i:04d}" for i in order]
    assert np.allclose([r.prob for r in top], np.exp(wide[order] - lse(wide)))
    assert S.log_masses(df.where("false"), ["yes", "no"]).count() == 0


def test_sinks_and_readers_round_trip(spark):
    from probelab.sources.tables import read_json, read_parquet
    out = tempfile.mkdtemp(dir="/tmp")
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5), ("a", 3, 2.5)], "dataset string, row_id long, value double")
    SK.write_parquet(df, os.path.join(out, "p"))
    assert {"dataset=a", "dataset=b"} <= set(os.listdir(os.path.join(out, "p")))
    back = read_parquet(spark, os.path.join(out, "p"))
    assert back.count() == 3 and set(back.columns) == {"dataset", "row_id", "value"}
    nested = SK.as_map(df, ["dataset"], "row_id", ["value"])
    SK.write_json(nested, os.path.join(out, "j"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("dataset", T.StringType()),
                           T.StructField("row_ids", T.MapType(T.StringType(), T.DoubleType()))])
    j = read_json(spark, os.path.join(out, "j"), schema=schema, multiline=False)   # maps need a schema
    flat = SK.explode_map(j, "row_ids")
    assert flat.count() == 3
