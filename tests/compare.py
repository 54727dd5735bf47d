"""Compares a query with its SQL in DuckDB, rows in any order."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.10g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(names, found):
    order = sorted(names)
    out = [tuple(plain(r[n]) for n in order) for r in found]
    return sorted(out, key=lambda x: tuple((y is None, str(type(y)), str(y)) for y in x))


def connect(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(df, sql, sf):
    want = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [r.asDict() for r in df.collect()])
    assert got == rows(want.columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
