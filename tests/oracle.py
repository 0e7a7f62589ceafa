"""Runs a query and its SQL on the same tables and compares columns, types by kind, and rows."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple((type(v := value(r[i])).__name__, v) for i in order)) for r in rows)


def compare(df, con, sql):
    """None, or what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{len(a)} and {len(b)} rows; only here {only[0]}; only there {only[1]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(names, (str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall())))
    odd = {c: (t, types[c]) for c, t in df.dtypes if t in kinds and kinds[t] != types[c]}
    return f"types {odd}" if odd else None
