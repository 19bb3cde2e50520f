"""Runs registered queries beside their SQL and compares sorted rows."""

from __future__ import annotations

import math
import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return float(x) if type(x).__name__ == "Decimal" else str(x) if type(x).__name__ in ("datetime", "Timestamp") else x


def differences(df, con, sql: str) -> str:
    """Empty when both give the same columns and rows."""
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(sql)
    own = [x[0] for x in found.description]
    if sorted(own) != names:
        return f"columns {names} and {sorted(own)}"
    want = sorted((tuple(plain(r[own.index(c)]) for c in names) for r in found.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
