"""Compares a query's rows with those of its SQL in DuckDB, types included."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "isoformat"):
        return x.replace(tzinfo=None).isoformat()
    return x


def compare(frame, sql: str, sf_dir: str) -> int:
    """Number of rows; fails if columns, types or rows differ."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    relation = con.sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(relation.columns)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: KINDS.get(t, t) for c, t in frame.dtypes} == theirs
    at = [relation.columns.index(c) for c in names]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in names) for r in frame.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
