"""Compare a Spark query with its SQL in DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> int:
    """Number of rows, if both sides have the same columns and rows; raises otherwise."""
    con = duck(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    want, have = rows_of(names, got.fetchall()), rows_of(df.columns, df.collect())
    odd = [(a, b) for a, b in zip(have, want) if a != b]
    assert len(have) == len(want) and not odd, (len(have), len(want), odd[:3])
    return len(have)
