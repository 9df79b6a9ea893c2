"""Run a registered query in Spark and its SQL twin in DuckDB; compare.

Both results are compared as multisets of rows after sorting columns by
name; doubles (already rounded by the queries) must match bit-exactly, as
a value hash would require; integers compare as ints; column types must
correspond.
"""

from __future__ import annotations

import math
import os

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v            # queries round to 6 digits themselves; compare bit-exactly
    if isinstance(v, int):
        return int(v)
    if hasattr(v, "__int__") and type(v).__name__ in ("Decimal",):
        f = float(v)
        return int(f) if f.is_integer() else round(f, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark, name, qfn, sql, sf_dir):
    sdf = qfn(spark, sf_dir)
    s_cols, s_rows = normalise(sdf.columns, [tuple(r) for r in sdf.collect()])
    con = duck(sf_dir)
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_cols, d_rows = normalise(d_cols_raw, res.fetchall())
    problems = []
    # column types: Spark's names mapped to DuckDB's (a schema check, not only values)
    spark_to_duck = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                     "float": "FLOAT", "boolean": "BOOLEAN"}
    d_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    for c, t in sdf.dtypes:
        if c in d_types and spark_to_duck.get(t, t) != d_types[c]:
            problems.append(f"type of {c}: spark={t} duck={d_types[c]}")
    if s_cols != d_cols:
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows)
