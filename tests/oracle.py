"""Compare registered queries with their SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "~null"
    if isinstance(value, float):
        return round(value, 6)
    return value


def compare(spark_df, con, sql: str) -> str:
    """'' when rows, columns and values agree, else what differs."""
    got = spark_df.toPandas()
    want = con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    columns = sorted(got.columns)
    for column in columns:  # pandas gets Spark's integers with NULLs as floats
        if str(want[column].dtype) == "Int64" and got[column].dtype == "float64":
            got[column] = got[column].astype("Int64")
    rows = lambda pdf: sorted(map(repr, (tuple(map(_cell, r)) for r in pdf[columns].astype(object).values.tolist())))
    a, b = rows(got), rows(want)
    if a != b:
        left = [x for x in a if x not in set(b)][:2]
        right = [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows vs {len(b)}; only here {left}; only there {right}"
    return "" if a else "no rows"
