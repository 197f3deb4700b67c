"""Run a registered query in Spark and its oracle in DuckDB and compare:
row count, column names, and the multiset of rows."""

from __future__ import annotations

import math

import duckdb

from kiln.sources.tables import TABLES, table_path


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(v)
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck_connection(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()]
    cur = con.execute(sql)
    d_cols_raw = [d[0] for d in cur.description]
    d_rows_raw = cur.fetchall()
    d_cols = sorted(d_cols_raw)
    idx = [d_cols_raw.index(c) for c in d_cols]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in d_rows_raw]
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row counts differ: spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
        a, b = sorted(s_rows, key=key), sorted(d_rows, key=key)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            problems.append(f"{len(bad)} differing rows, e.g. spark={bad[0][0]} duck={bad[0][1]}")
    return problems, dict(zip(sdf.columns, [f.dataType.simpleString() for f in sdf.schema.fields])), \
        dict(zip(d_cols_raw, [str(d[1]) for d in cur.description]))
