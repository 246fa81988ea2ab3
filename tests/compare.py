"""Compare a Spark result with the result of its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4) + 0.0
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def kinds(rows: list[tuple]) -> list[set]:
    width = len(rows[0]) if rows else 0
    return [{type(r[i]).__name__ for r in rows if r[i] is not None} for i in range(width)]


def differences(spark_df, relation) -> list[str]:
    """Empty when both results agree in names, row count, kinds and values."""
    got_cols, want_cols = spark_df.columns, [d[0] for d in relation.description]
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} != {sorted(want_cols)}"]
    got = canonical(got_cols, [tuple(r) for r in spark_df.collect()])
    want = canonical(want_cols, relation.fetchall())
    problems = []
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if kinds(got) != kinds(want):
        problems.append(f"kinds {kinds(got)} != {kinds(want)}")
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b][:3]
        problems.append(f"values differ: {pairs}")
    return problems
