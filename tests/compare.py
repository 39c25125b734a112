"""Rows of a Spark query against rows of its SQL twin, whatever their order."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sql, sf_dir):
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for p in sorted(Path(sf_dir).glob("*.parquet")):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        got = c.execute(sql)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
