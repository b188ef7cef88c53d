"""Compares a query with its SQL: columns by name, then values without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from ferrule.plans.session import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:26]
    return v


def difference(spark_df, con, sql: str) -> str:
    """Empty where both agree."""
    cols = sorted(spark_df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    pick = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in pick) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    if got == want:
        return ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows, SQL {len(want)}; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
