"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_plain(v) for v in value)
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (np.floating, Decimal)):
        value = float(value)
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark_df, con, sql) -> str | None:
    """None when both sides give the same columns and rows, otherwise a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    left = _normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = _normal(names, result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"row count {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            bad = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y or type(x) is not type(y)]
            return f"first difference {bad} in {a}"
    return None
