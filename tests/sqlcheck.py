"""Runs a query and its SQL side by side."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def assert_equal(spark, folder, query, sql):
    df = query(spark, folder)
    cur = connect(folder).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want
