"""The pipeline's stages on empty tables, nulls, repeats and clashing names."""

import pytest

import corpus_pipeline as P
from probelab.llm import pii, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, key string, rank int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows():
    long = " ".join(f"word{i}" for i in range(60))
    return [(1, "plain text " * 20, "en", "a", 220, "k1", "x", 7), (2, "more plain text " * 20, "en", "a", 320, "k2", "x", 7),
            (None, long, None, None, None, "k3", "x", 7), (None, long, None, None, None, "k4", "x", 7), (3, long, "de", "b", 400, "k5", "x", 7),
            (4, None, "de", "b", None, "k6", "x", 7), (5, "", "fr", "c", 0, "k7", "x", 7), (6, "mail a@b.org", "fr", "c", 12, "k8", "x", 7)]


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == 0
    assert quality.classify(docs, docs.select("doc_id")).count() == 0 and pii.find_pii(docs).count() == 0


def test_clashing_names_and_nulls(spark, sf_dir):
    docs = spark.createDataFrame(rows(), DOCS)
    good = P.quality_classifier(spark, docs, sf_dir)
    kept = {r.row_key: tuple(r) for r in good.collect()}
    assert good.columns == docs.columns and "k6" not in kept and all(kept[r[5]] == r for r in rows() if r[5] in kept)
    alone = P.near_dedup(spark, docs, sf_dir)
    kept = {r.row_key: tuple(r) for r in alone.collect()}
    assert alone.columns == docs.columns and set(kept) == {"k1", "k2", "k5", "k6", "k7", "k8"}      # of three copies the named one
    assert all(kept[r[5]] == r for r in rows() if r[5] in kept)
    clean = {r.row_key: r.text for r in P.redact_pii(spark, docs, sf_dir).collect()}
    assert clean["k8"] == "mail <EMAIL>" and clean["k6"] is None and clean["k5"] == rows()[4][1]
