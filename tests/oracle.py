"""Compares a Spark result with DuckDB's answer over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}") + 0.0
    return str(v)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in data)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = spark_df.collect()
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(want_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} but {sorted(want_columns)}"
    a, b = rows(spark_df.columns, got), rows(want_columns, want)
    if a == b:
        return ""
    return f"{len(got)} and {len(want)} rows; only Spark {list((a - b).items())[:3]}; only DuckDB {list((b - a).items())[:3]}"
