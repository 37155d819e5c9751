"""Run a registered query and its SQL twin on the same tables and compare the rows."""
from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

# Fixed names of the given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == int(v) if math.isfinite(v) else False:
            return str(int(v))
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    cols = sorted(names)
    ix = [names.index(c) for c in cols]
    return cols, sorted(tuple(norm(r[i]) for i in ix) for r in rows)


def kinds(df, con, sql):
    """Broad type kinds per column on both sides, for schema agreement."""
    def kind(t):
        t = t.lower()
        for k, names in {"int": ("int", "long"), "float": ("double", "float"), "str": ("string", "varchar"),
                         "dec": ("decimal", "huge")}.items():
            if any(n in t for n in names):
                return "dec" if "huge" in t else k
        return t
    a = {c: kind(t) for c, t in df.dtypes}
    b = {d[0]: kind(str(d[1])) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    return {c: (a.get(c), b.get(c)) for c in a | b if a.get(c) != b.get(c)}
