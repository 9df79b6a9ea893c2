"""Question catalogue.

The catalogue is data: any number of sets with any names. The built-in one
has the shape of the published design (per sense 4 low- and 4
high-metaphoricity predicates over 5 senses, plus 10 random-word controls
with a null covariate) in wording of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOGUE_SCHEMA = T.StructType([
    T.StructField("q_idx", T.IntegerType(), False),
    T.StructField("qid", T.StringType(), False),
    T.StructField("sense", T.StringType(), False),
    T.StructField("predicate", T.StringType(), False),
    T.StructField("question", T.StringType(), False),
    T.StructField("set", T.StringType(), False),
    T.StructField("a_priori_metaphoricity", T.DoubleType(), True),
])

SENSES = ["sight", "taste", "touch", "hearing", "smell"]
LOW, HIGH, CONTROL = "SYN_LOW", "SYN_HIGH", "GIB"

_ASK = {
    "sight": "Does this text look {p}?",
    "taste": "Would this text taste {p}?",
    "touch": "Would this text feel {p} to the touch?",
    "hearing": "Does this text sound {p}?",
    "smell": "Would this text smell {p}?",
    "control": "Is this text {p}?",
}

# Four predicates a sense for either set; the a-priori metaphoricity follows
# from the set and the place in the list. Callers with a catalogue of their
# own read it from a file.
_LITERAL = {
    "sight": ("striped", "oval", "glossy", "freckled"),
    "taste": ("minty", "starchy", "oily", "yeasty"),
    "touch": ("rubbery", "gritty", "sticky", "feathery"),
    "hearing": ("humming", "crackling", "echoing", "ticking"),
    "smell": ("piney", "soapy", "mouldy", "leathery"),
}
_FIGURATIVE = {
    "sight": ("radiant", "murky", "vivid", "faded"),
    "taste": ("zesty", "stale", "savoury", "syrupy"),
    "touch": ("prickly", "heavy", "brittle", "silken"),
    "hearing": ("muffled", "thunderous", "melodic", "jarring"),
    "smell": ("perfumed", "acrid", "airy", "rancid"),
}
_LOW = [(sense, p, round(0.05 + 0.1 * i, 2)) for sense, ps in _LITERAL.items() for i, p in enumerate(ps)]
_HIGH = [(sense, p, round(0.55 + 0.1 * i, 2)) for sense, ps in _FIGURATIVE.items() for i, p in enumerate(ps)]
_CONTROL = ["florp", "zindle", "quabby", "marnish", "trelvic",
            "blumphy", "snorvel", "wuggish", "prindly", "kestic"]


def set_of(qid: Column) -> Column:
    """The set follows from the qid prefix."""
    return (F.when(qid.startswith("low_"), F.lit(LOW))
             .when(qid.startswith("high_"), F.lit(HIGH))
             .otherwise(F.lit(CONTROL)))


def default_rows() -> list[tuple]:
    """LOW + HIGH + control, in this order (q_idx is the position)."""
    rows = []
    for prefix, items in (("low", _LOW), ("high", _HIGH)):
        for sense, pred, meta in items:
            rows.append((f"{prefix}_{pred}", sense, pred, _ASK[sense].format(p=pred), meta))
    for w in _CONTROL:
        rows.append((f"gib_{w}", "control", w, _ASK["control"].format(p=w), None))
    out = []
    for i, (qid, sense, pred, q, meta) in enumerate(rows):
        s = LOW if qid.startswith("low_") else HIGH if qid.startswith("high_") else CONTROL
        out.append((i, qid, sense, pred, q, s, meta))
    return out


def catalogue(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """The catalogue as a DataFrame with an explicit schema."""
    return spark.createDataFrame(rows or default_rows(), CATALOGUE_SCHEMA)


def catalogue_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """A user catalogue: qid, sense, predicate, question[, a_priori_metaphoricity]; the
    set is derived (P6) and q_idx is the file order given by the caller as a column
    when present."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if "a_priori_metaphoricity" not in df.columns:
        df = df.withColumn("a_priori_metaphoricity", F.lit(None).cast("double"))
    return df.select(F.col("q_idx").cast("int"), "qid", "sense", "predicate", "question",
                     set_of(F.col("qid")).alias("set"),
                     F.col("a_priori_metaphoricity").cast("double"))


def select_qids(cat: DataFrame, sets: list[str] | None = None, sense: str | None = None,
                exclude_prefix: str | None = None) -> DataFrame:
    """Catalogue rows of some sets / one sense / without a prefix."""
    out = cat
    if sets is not None:
        out = out.filter(F.col("set").isin(sets))
    if sense is not None:
        out = out.filter(F.col("sense") == sense)
    if exclude_prefix is not None:
        out = out.filter(~F.col("qid").startswith(exclude_prefix))
    return out


def local_list(cat: DataFrame, max_rows: int = 10_000) -> list[dict]:
    """The catalogue on the driver, size-checked: it is a design table (tens of
    questions), never data-sized."""
    rows = cat.orderBy("q_idx").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"catalogue has more than {max_rows} questions")
    return [r.asDict() for r in rows]
