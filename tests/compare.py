"""Rows of Spark and of DuckDB in one comparable form."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def duck_rows(sql, sf_dir=None, **tables):
    """Rows of a statement over the parquet tables of a folder, or over given Arrow or pandas tables."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet") if sf_dir else ():
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, t in tables.items():
        con.register(name, t)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(repr(tuple(plain(r[k]) for k in at)) for r in got.fetchall())
