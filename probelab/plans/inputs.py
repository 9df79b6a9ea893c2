"""Labelled datasets built from the driver tables.

* ``lang``    : documents, label = language (4 classes)
* ``quality`` : documents joined with labels, label = quality (names low/high)
* ``role``    : conversation turns, label = speaker role
* ``embeddings`` : the numeric feature matrix (its first elements are the
  probe features, in catalogue order), label = its 10-class label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelab.operators import prepare as P
from probelab.sources.tables import read_table

QUALITY_NAMES = ["low", "high"]


def raw_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return P.labelled_text(docs, "lang", id_col="doc_id", label_col="lang")


def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table joined to its texts on the document key."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return P.labelled_text(docs.join(labels, "doc_id"), "quality", id_col="doc_id",
                           label_col="quality", names=QUALITY_NAMES)


def raw_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    conv = conv.withColumn("turn_id", F.col("conv_id") * F.lit(1 << 31) + F.col("turn"))
    return P.labelled_text(conv, "role", id_col="turn_id", label_col="role")


def raw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["dataset", "row_id", "text", "label_text"]
    lang = P.index_labels(raw_lang(spark, sf_dir)).select(*cols, "label")
    role = P.index_labels(raw_role(spark, sf_dir)).select(*cols, "label")
    return lang.unionByName(raw_quality(spark, sf_dir).select(*cols, "label")).unionByName(role)


def prepared_all(spark: SparkSession, sf_dir: str, n_total: int = P.N_TOTAL) -> DataFrame:
    return P.prepare(raw_all(spark, sf_dir), n_total=n_total)


def described_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every dataset, cleaned and whole: what the reports describe."""
    return P.index_labels(P.clean(raw_all(spark, sf_dir), None))
