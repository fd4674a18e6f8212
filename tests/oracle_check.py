"""Compares a query's rows with those of its SQL text in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1.01e-4 * max(1, 1e-4 * abs(a))
    return a == b


def differences(df, text: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(text)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    got = [tuple(r[c] for c in sorted(names)) for r in df.collect()]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in want]
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    key = lambda r: [(x is None, str(type(x).__name__), x if x is not None else 0) for x in r]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        if not all(same(x, y) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""
