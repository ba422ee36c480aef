"""Holds a Spark query against its SQL in DuckDB, as multisets of rounded rows."""

from __future__ import annotations

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return repr(value)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
