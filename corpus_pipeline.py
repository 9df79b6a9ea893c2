"""From raw documents to packed training sequences.

Stages, each a function (spark, docs, sf_dir) -> DataFrame over all rows that
the stage before kept: drop low-quality documents, keep one document of each
group of near-duplicates, redact personal data, mix the sources to their
target weights, pack into sequences. All but the last return the columns of
``documents``. Nulls, empty texts and empty tables follow the operators'
docstrings; a rejected document is one with a null text or a perplexity
outside its language's bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelab.llm import hyperminhash, mixing, packing, pii, quality
from probelab.llm.shared import discard, join_keys, noted, written
from probelab.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before has left behind.
_LEFT: list[tuple[str, str | None]] = []


def _stage(work: Stage) -> Stage:
    """A stage reads what the one before wrote as its result, so the tables
    that one worked with are deleted first."""
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        discard(spark, _LEFT)
        with noted() as made:
            out = work(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a key of its own for each row, so that rows with
    a null or shared doc_id are decided one by one, and the key's name, which
    no column of ``docs`` has."""
    key = "row_key"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def _by_key(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.withColumn("doc_id", F.col(key))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = _keyed(docs)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    trusted = join_keys(keyed, good, "doc_id", "left_semi").select(F.col(key).alias("doc_id"))
    rejected = quality.classify(_by_key(keyed, key), trusted).where("not kept").select(F.col("doc_id").alias(key))
    return join_keys(keyed.where("text is not null"), written(rejected), key, "left_anti").select(docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays
    (nulls last, then by text)."""
    keyed, key = _keyed(docs)
    found = written(hyperminhash.near_duplicates(_by_key(keyed, key)).select(F.col("doc_id").alias("key"), "component_id", "kept"))
    groups = written(found.where("not kept").select("component_id").distinct())
    rank = keyed.select(F.col(key).alias("key"), F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"), F.col(key).alias("key")).alias("rank"))
    rows = written(join_keys(found, groups, "component_id", "left_semi").join(rank, "key").select("key", "component_id", "rank"))
    first = rows.groupBy("component_id").agg(F.min("rank").alias("first"))
    dropped = written(rows.join(first, "component_id").where("key <> first.key").select(F.col("key").alias(key)))
    return join_keys(keyed, dropped, key, "left_anti").select(docs.columns)


@_stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc.*")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("PII", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot train the model, hash or pack; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
