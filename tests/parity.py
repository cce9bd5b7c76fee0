"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{round(float(value), 8) + 0.0:.8f}"
    return str(value)


def differences(spark, query, sql: str) -> list:
    """Rows that only one side has, at most a few of them."""
    left = query(spark, FOLDER)
    names = sorted(left.columns)
    ours = sorted(tuple(_plain(r[c]) for c in names) for r in left.collect())
    with duckdb.connect() as con:
        for t in TABLES:
            path = f"{FOLDER}/{t}.parquet"
            con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
        con.execute(sql)
        found = [d[0] for d in con.description]
        assert sorted(found) == names
        theirs = sorted(tuple(_plain(r[found.index(c)]) for c in names) for r in con.fetchall())
    return [pair for pair in zip(ours, theirs) if pair[0] != pair[1]][:3] + ([(len(ours), len(theirs))] if len(ours) != len(theirs) else [])
