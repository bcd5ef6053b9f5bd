"""Compares queries with their SQL, as rows in any order with columns by name."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        source = p / "*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def difference(spark, con, query, sql, folder):
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if mine == theirs:
        return None
    a, b = set(mine), set(theirs)
    return f"{len(mine)} and {len(theirs)} rows; only Spark {sorted(a - b, key=repr)[:3]}; only SQL {sorted(b - a, key=repr)[:3]}"
