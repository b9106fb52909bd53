"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def key(row: tuple) -> tuple:
    return tuple("" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v) for v in row)


def same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


def differences(spark, query, sql: str) -> list[str]:  # noqa: ANN001
    df = query(spark, DATA)
    names = sorted(df.columns)
    mine = sorted((tuple(x) for x in df.select(*names).collect()), key=key)
    with duck() as con:
        cursor = con.execute(sql)
        there = [d[0] for d in cursor.description]
        rows = cursor.fetchall()
    if sorted(there) != names:
        return [f"columns {names} and {sorted(there)}"]
    order = [there.index(n) for n in names]
    other = sorted((tuple(x[i] for i in order) for x in rows), key=key)
    if len(mine) != len(other):
        return [f"{len(mine)} rows and {len(other)}"]
    return [f"{a} and {b}" for a, b in zip(mine, other, strict=True) if not all(map(same, a, b))]
