"""Side-by-side run of a registered query and its DuckDB text."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con, sql):
    """Empty if the result of ``df`` and ``sql`` is the same bag of rows."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    out = [] if len(got) == len(want) else [f"rows {len(got)} / {len(want)}"]
    if got != want:
        a, b = set(got), set(want)
        out += [f"spark {sorted(a - b)[:2]}", f"duckdb {sorted(b - a)[:2]}"]
    return out
