"""Rows of a query against its DuckDB SQL, whatever their order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def kind(t: str) -> str:
    t = t.lower()
    for k, words in (("int", ("int", "long", "short", "byte")), ("float", ("double", "float", "real")), ("decimal", ("decimal",)), ("text", ("varchar", "string")), ("bool", ("bool",)), ("time", ("timestamp",)), ("date", ("date",)), ("list", ("[]", "array"))):
        if any(w in t for w in words):
            return k
    return t


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    ours, theirs = {f: kind(t) for f, t in df.dtypes}, {x[0]: kind(str(x[1])) for x in cur.description}
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if ours != theirs:
        return f"types {ours} and {theirs}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
        return f"{len(got)} and {len(want)} rows; {str(bad)[:500]}"
    return None
