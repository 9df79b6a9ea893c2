"""Out-of-fold predictions of many nearest-centroid classifiers at once.

A matrix row is ``(dataset, row_id, label, fold, x)``; a config names a
dataset and the elements of ``x`` that a model uses. Each row is predicted by
the centroids of the folds it is not in, on standardised elements; the nearest
one wins, the smallest label among equally near ones.

One pass sums values and squares by (dataset, fold, label, element) with
map-side aggregates, so a class of any size is never in one task; what a held
fold needs is the total less the fold's own sums, so no row is read k times.
Values are whole millionths, so the sums are exact and the same in any order.
The centroids are a table of datasets x folds x classes x elements, whatever
the number of rows, which every task gets; a second pass reads each row once
for all configs.

A null element does not count in its centroid and adds no distance. A class
without training rows is not predicted; a fold that holds all rows of its
dataset is not predicted at all. Constant elements have scale 1.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.session import cut_lineage, ship_package, spread

#: Values are compared as whole numbers of 1 / UNIT.
UNIT = 1_000_000
#: Rows whose distances a task holds at a time.
ROWS_AT_ONCE = 2048


def whole_values(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("x", F.transform("x", lambda v: F.floor(v * float(UNIT) + 0.5).cast("bigint")))


def fold_sums(whole: DataFrame) -> DataFrame:
    """``(dataset, fold, label, pos, n, s, ss)``: count, sum and sum of squares."""
    return (whole.select("dataset", "fold", "label", F.posexplode("x").alias("pos", "v"))
            .groupBy("dataset", "fold", "label", "pos")
            .agg(F.count("v").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).cast("decimal(19,0)").alias("s"),
                 F.sum((F.col("v") * F.col("v")).cast("decimal(19,0)")).cast("decimal(26,0)").alias("ss")))


def training_sums(sums: DataFrame, k: int) -> DataFrame:
    """``(dataset, held, label, pos, n, s, ss)`` of all folds but the held one."""
    held = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("held")
    spread = sums.select("*", held).where("held <> fold")
    total = [F.sum(c).cast(t).alias(c) for c, t in (("n", "bigint"), ("s", "decimal(19,0)"), ("ss", "decimal(26,0)"))]
    return spread.groupBy("dataset", "held", "label", "pos").agg(*total)


def centroids(sums: DataFrame, k: int = 5) -> DataFrame:
    """One row per (dataset, held): ``scale`` by element and ``classes``, an
    array of (label, centroid by element)."""
    train = training_sums(sums, k)
    n = F.sum("n").cast("decimal(12,0)")
    spread = (n * F.sum("ss").cast("decimal(26,0)") - F.sum("s").cast("decimal(19,0)") * F.sum("s").cast("decimal(19,0)")).cast("double")
    sd = F.sqrt(F.greatest(spread, F.lit(0.0))) / F.sum("n").cast("double")
    scale = train.groupBy("dataset", "held", "pos").agg(F.when(spread > 0, sd).otherwise(1.0).alias("scale"))
    by_pos = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda p: p[c])
    scales = scale.groupBy("dataset", "held").agg(by_pos("scale").alias("scale"))
    mean = F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n").cast("double"))
    means = train.withColumn("m", mean).groupBy("dataset", "held", "label").agg(by_pos("m").alias("m"), F.max("n").alias("n")).where("n > 0")
    classes = means.groupBy("dataset", "held").agg(F.sort_array(F.collect_list(F.struct("label", "m"))).alias("classes"))
    return classes.join(scales, ["dataset", "held"])


def _design(model: DataFrame, configs: Sequence[tuple]) -> dict:
    """By (dataset, fold): labels, centroids (classes, elements) and scales,
    NaN where there is none; and by dataset its configs."""
    own: dict[str, list] = {}
    for c, ds, cols in configs:
        own.setdefault(ds, []).append((c, tuple(int(i) for i in cols)))
    known = {}
    for r in model.toLocalIterator():           # datasets x folds rows
        if r["dataset"] not in own:
            continue
        width = 1 + max([len(r["scale"]) - 1, *(i for _, cols in own[r["dataset"]] for i in cols)])
        fill = lambda v: np.array([*(np.nan if x is None else x for x in v), *[np.nan] * (width - len(v))])  # noqa: E731, B023
        known[r["dataset"], r["fold"]] = ([c["label"] for c in r["classes"]], np.array([fill(c["m"]) for c in r["classes"]]), fill(r["scale"]))
    return {"models": known, "configs": own}


def _vectors(lists, width: int) -> np.ndarray:
    """(elements, rows) of a list array, NaN for a null or missing element."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)        # null: NaN
    row = np.repeat(np.arange(len(lists)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    x = np.full((width, len(lists)), np.nan)
    kept = at < width
    x[at[kept], row[kept]] = flat[kept]
    return x


def _nearest(design: dict, rb):
    """For the rows of each dataset and fold of a batch and each config:
    ``(config id, dataset, fold, rows, labels of the classes, place of the
    nearest one)``. Distances are added element by element in the config's
    order; a config that goes on from the one before adds to its distances."""
    ids = rb.column("dataset").to_numpy(zero_copy_only=False), rb.column("fold").to_pandas().to_numpy()
    for ds, fold in {(d, f) for d, f in zip(*ids)}:
        if (ds, fold) not in design["models"]:
            continue
        labels, m, scale = design["models"][ds, fold]
        rows = np.flatnonzero((ids[0] == ds) & (ids[1] == fold))
        x = _vectors(rb.column("x").take(pa.array(rows)), len(scale))
        for sub in range(0, len(rows), ROWS_AT_ONCE):
            part = x[:, sub:sub + ROWS_AT_ONCE]
            z: dict[int, np.ndarray] = {}
            before, d = (), None
            for config, cols in design["configs"][ds]:
                if d is None or cols[:len(before)] != before:
                    before, d = (), np.zeros((len(labels), part.shape[1]))
                for i in cols[len(before):]:
                    if i not in z:
                        apart = (part[i] - m[:, i, None]) / scale[i]
                        z[i] = np.nan_to_num(apart * apart, nan=0.0)
                    d = d + z[i]
                before = cols
                yield config, ds, int(fold), rows[sub:sub + ROWS_AT_ONCE], labels, np.argmin(d, axis=0)


def predictions(matrix: DataFrame, configs: Sequence[tuple], k: int = 5, output: str = "oof") -> DataFrame:
    """``(config_id, dataset, row_id, fold, label, pred)`` for every row and
    every config ``(config_id, dataset, cols)`` of its dataset; with
    ``output='confusion'`` their counts ``(config_id, fold, label, pred, n)``,
    added up in each task, so that no row is multiplied by the configs."""
    spark = matrix.sparkSession
    ship_package(spark)
    whole = cut_lineage(spread(whole_values(matrix), "row_id"))       # both passes read it
    sent = spark.sparkContext.broadcast(_design(centroids(fold_sums(whole), k).withColumnRenamed("held", "fold"), configs))

    def rows_of(batches):
        for rb in batches:
            for config, ds, fold, rows, labels, at in _nearest(sent.value, rb):
                own = pa.array(rows)
                n, pred = len(rows), pa.array(labels, pa.int32()).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([config] * n), pa.array([ds] * n), rb.column("row_id").take(own), pa.array([fold] * n, pa.int32()),
                                                  rb.column("label").take(own), pred], ["config_id", "dataset", "row_id", "fold", "label", "pred"])

    def counts_of(batches):
        n: dict[tuple, int] = {}
        for rb in batches:
            coded = pc.dictionary_encode(rb.column("label"), null_encoding="encode")
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            for config, _, fold, rows, labels, at in _nearest(sent.value, rb):
                pairs = np.bincount(code[rows] * len(labels) + at, minlength=len(names) * len(labels))
                for p in np.flatnonzero(pairs):
                    key = (config, fold, names[p // len(labels)], labels[p % len(labels)])
                    n[key] = n.get(key, 0) + int(pairs[p])
        if n:
            columns = list(zip(*n))
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types)), pa.array(list(n.values()), pa.int64())],
                                             ["config_id", "fold", "label", "pred", "n"])

    rows = whole.select("dataset", "row_id", F.col("fold").cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "x") \
        .where("dataset is not null and fold is not null")
    if output == "oof":
        return rows.mapInArrow(rows_of, "config_id string, dataset string, row_id bigint, fold int, label int, pred int")
    # configs x folds x classes^2 rows, read by every metric on it: made once
    return cut_lineage(rows.mapInArrow(counts_of, "config_id string, fold int, label int, pred int, n bigint")
                       .groupBy("config_id", "fold", "label", "pred").agg(F.sum("n").alias("n")))
