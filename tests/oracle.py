"""Holds queries against their SQL on the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[n]) for n in names) for r in df.collect()), names


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    own = [d[0] for d in cur.description]
    names = sorted(own)
    at = [own.index(n) for n in names]
    return Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), names


def differences(df, sql: str, sf_dir: str) -> str | None:
    a, an = spark_rows(df)
    b, bn = sql_rows(sql, sf_dir)
    if an != bn:
        return f"columns {an} / {bn}"
    if a != b:
        return f"rows {a.total()} / {b.total()}; only here {list((a - b))[:2]}; only in SQL {list((b - a))[:2]}"
    return None
