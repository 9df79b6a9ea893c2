"""Feature-list experiments on top of M3.

Config tables are design data (datasets x feature lists); every experiment
is one ``evaluate_many`` call over all datasets at once. Greedy forward
selection is a driver loop of at most |features| rounds; each round fits
every remaining candidate of every dataset and set in one job, and only the
winners (one row per chain) come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelab.operators import evaluate as EV
from probelab.operators import metrics as M
from probelab.operators.stats import TIE_DIGITS
from probelab.sources.catalog import CONTROL, HIGH, LOW, SENSES


def columns_by_set(cat_rows: Sequence[dict]) -> dict[str, list[int]]:
    """Element positions per set in catalogue order; ALL = LOW + HIGH."""
    out = {LOW: [], HIGH: [], CONTROL: []}
    for r in cat_rows:
        out.setdefault(r["set"], []).append(int(r["q_idx"]))
    out["SYN_ALL"] = out[LOW] + out[HIGH]
    return out


def group_configs(datasets: Sequence[str], cat_rows, groups=(LOW, HIGH, "SYN_ALL", CONTROL)):
    """M4: one config per (dataset, group)."""
    cols = columns_by_set(cat_rows)
    return [(f"{d}|{g}", d, cols[g]) for d in datasets for g in groups]


def univariate_configs(datasets: Sequence[str], cat_rows):
    """M5: one config per (dataset, question)."""
    return [(f"{d}|{r['qid']}", d, [int(r["q_idx"])]) for d in datasets for r in cat_rows]


def sense_configs(datasets: Sequence[str], cat_rows, senses=SENSES):
    """M6: the low-metaphoricity questions of each sense."""
    out = []
    for d in datasets:
        for s in senses:
            cols = [int(r["q_idx"]) for r in cat_rows if r["sense"] == s and r["set"] == LOW]
            if cols:
                out.append((f"{d}|{s}", d, cols))
    return out


def split_id(df: DataFrame, names=("dataset", "item")) -> DataFrame:
    parts = F.split(F.col("config_id"), r"\|")
    return df.select(*[parts[i].alias(n) for i, n in enumerate(names)],
                     *[c for c in df.columns if c != "config_id"])


def _session(matrix: DataFrame | None, prepared: EV.Prepared | None = None, **_):
    return (prepared.blocks if prepared is not None else matrix).sparkSession


def run_configs(matrix: DataFrame | None, rows, **kw) -> DataFrame:
    """M3 + A11 + A12 over a list of configs: ``config_id, acc, acc_std, n_folds, f1``."""
    spark = _session(matrix, **kw)
    conf = EV.evaluate_many(matrix, EV.config_frame(spark, rows), **kw)
    return M.cv_summary(conf)


def greedy_forward(matrix: DataFrame | None, chains: dict[tuple[str, str], Sequence[int]],
                   qid_of: dict[int, str], max_k: int | None = None, *, k: int = 5,
                   prepared: EV.Prepared | None = None, C: float = 1.0) -> DataFrame:
    """M7: for every chain (dataset, set) with candidate columns, the full
    forward path ``(dataset, set, k, acc, qid)``; ties go to the earliest
    candidate (W8).

    The fold sums and cross-products are added once for all rounds, and the
    candidates of a round start from the weights of the last winner, so a
    round is a few gradient passes over all candidates of all chains."""
    prep = prepared or EV.prepare(matrix, k)
    spark = prep.blocks.sparkSession
    chosen = {c: [] for c in chains}
    remaining = {c: list(v) for c, v in chains.items()}
    won: dict[tuple[str, str], dict] = {c: {} for c in chains}
    curve = []
    limit = max_k or max((len(v) for v in chains.values()), default=0)
    try:
        for _ in range(limit):
            rows, start = [], {}
            for (ds, st), rem in remaining.items():
                for pos, j in enumerate(rem):
                    config = f"{ds}|{st}|{j}|{pos}"
                    rows.append((config, ds, chosen[(ds, st)] + [j]))
                    start.update({(config, held): w for held, w in won[(ds, st)].items()})
            if not rows:
                break
            conf, weights = EV.fit_and_predict(prep, rows, C, start=start)
            parts = F.split(F.col("config_id"), r"\|")
            scored = M.cv_accuracy(conf).select(
                "config_id", parts[0].alias("dataset"), parts[1].alias("set"),
                parts[2].cast("int").alias("col"), parts[3].cast("int").alias("col_idx"), "acc",
                F.round("acc", TIE_DIGITS).alias("tied"))      # equal up to the order of adding the folds
            found = {(r["dataset"], r["set"]): r for r in M.best_candidate(scored, ["dataset", "set"], "tied").collect()}
            for key in remaining:
                r = found.get(key)
                if r is None:                       # no rows, or no candidate left
                    remaining[key] = []
                    continue
                won[key] = {held: w for (c, held), w in weights.items() if c == r["config_id"]}
                chosen[key].append(r["col"])
                remaining[key].remove(r["col"])
                curve.append((*key, len(chosen[key]), float(r["acc"]), qid_of[r["col"]]))
    finally:
        if prepared is None:
            prep.release()
    return spark.createDataFrame(curve, "dataset string, set string, k int, acc double, qid string")


def random_order_configs(orders: DataFrame, q_idx_of: dict[str, int]):
    """M8 configs from W9 orders: for every (dataset, perm, k) the first k
    features of the order. The orders table is design-sized."""
    rows = orders.orderBy("dataset", "perm", "k").collect()
    seq, out = {}, []
    for r in rows:
        key = (r["dataset"], r["perm"])
        seq.setdefault(key, []).append(q_idx_of[r["qid"]])
        out.append((f"{r['dataset']}|{r['perm']}|{r['k']}", r["dataset"], list(seq[key])))
    return out


def random_order_curves(matrix: DataFrame | None, orders: DataFrame, q_idx_of: dict[str, int], **kw) -> DataFrame:
    """M8: CV accuracy of every prefix of every random order:
    ``(dataset, perm, k, acc)``."""
    spark = _session(matrix, **kw)
    acc = M.cv_accuracy(EV.evaluate_many(matrix, EV.config_frame(spark, random_order_configs(orders, q_idx_of)), **kw))
    parts = F.split(F.col("config_id"), r"\|")
    return acc.select(parts[0].alias("dataset"), parts[1].cast("int").alias("perm"),
                      parts[2].cast("int").alias("k"), "acc")
