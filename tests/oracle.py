"""Holds a query's rows against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from leafline.sources.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_df, sql: str, sf_dir: str) -> str:
    """What differs, or an empty text."""
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    if len(want) != len(have):
        return f"{len(have)} rows, {len(want)} wanted: {have[:3]} {want[:3]}"
    odd = [(h, w) for h, w in zip(have, want, strict=True) if h != w]
    return f"{len(odd)} of {len(want)} rows differ: {odd[:3]}" if odd else ""
