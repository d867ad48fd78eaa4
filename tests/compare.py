"""Compare a Spark result with DuckDB's answer to the query's SQL."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(folder) / t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else float(v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool)
                 else (False, "number", x) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float"}


def difference(df, con, sql) -> str | None:
    """None if names, types and rows agree exactly; else what differs."""
    res = con.execute(sql)
    d_names = [c[0] for c in res.description]
    d_types = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in res.description}
    d_cols, d_rows = rows_of(d_names, res.fetchall())
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if s_cols != d_cols:
        return f"columns {s_cols} / {d_cols}"
    s_types = dict(df.dtypes)
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} / {len(d_rows)}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(s_rows)} rows differ in {s_cols}: {bad[:2]}"
    types = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    return f"types {types}" if types else None
