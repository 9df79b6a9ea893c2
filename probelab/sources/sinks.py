"""Sinks (S5, S6, S7) and nested export.

Results are tidy tables; nesting happens only at export, with
``struct`` / ``collect_list`` / ``map_from_entries`` on small aggregated
tables, written by Spark (``coalesce(1)`` only on those result-sized
tables, never on data-sized ones).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by=("dataset",), mode: str = "overwrite") -> None:
    """One directory per dataset (``partitionBy``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = True) -> None:
    """Header, no index column. ``single_file`` for result-sized tables."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row of a (small) nested result table."""
    df.coalesce(1).write.mode(mode).json(path)


def as_map(df: DataFrame, keys, key_col: str, value_cols) -> DataFrame:
    """Nest ``value_cols`` under ``key_col`` as a map per ``keys`` group."""
    v = F.struct(*value_cols) if len(value_cols) > 1 else F.col(value_cols[0])
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key_col), v))).alias(key_col + "s"))


def explode_map(df: DataFrame, col: str, key: str = "key", value: str = "value") -> DataFrame:
    """Walk a nested map (e.g. per-question utilities of a results tree)."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.explode(col).alias(key, value))
