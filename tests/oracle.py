"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"max_temp_directory_size": "2GB"})  # a query that goes wrong must not fill the disk
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def cell(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """The number of rows, and what differs (at most a few lines)."""
    df = query(spark, sf_dir)
    res = connection(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(res.columns):
        return 0, [f"columns {sorted(df.columns)} and {sorted(res.columns)}"]
    ours, theirs = rows(df.columns, df.collect()), rows(res.columns, res.fetchall())
    if ours == theirs:
        return len(ours), []
    a, b = [x for x in ours if x not in set(theirs)] if len(ours) < 2000 else list(set(ours) - set(theirs)), list(set(theirs) - set(ours))
    return len(ours), [f"{len(ours)} and {len(theirs)} rows; columns {sorted(df.columns)}", *(f"ours: {x}" for x in a[:3]), *(f"SQL: {x}" for x in b[:3])]
