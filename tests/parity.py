"""Runs registered queries beside their SQL on the same tables: rows, columns and values as a sorted multiset."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 5) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    return value


def compare(spark, con, name, function, sql, sf_dir) -> str:
    """Empty if both agree, else what differs."""
    found = con.execute(sql)
    columns = sorted(d[0] for d in found.description)
    index = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in index) for r in found.fetchall()), key=repr)
    df = function(spark, sf_dir)
    if sorted(df.columns) != columns:
        return f"{name}: columns {sorted(df.columns)} and {columns}"
    got = sorted((tuple(normal(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{name}: {len(wrong)} of {len(got)} rows differ, as {wrong[0]}" if wrong else ""
