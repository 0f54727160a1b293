"""Spark result against DuckDB result: same columns, same rows in any order, numbers to 6 decimals."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = round(float(v), 5)
        return int(f) if f == int(f) else f
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql):
    """None if they agree, else a short account."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        only, other = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} rows against {len(want[1])}; only here {len(only)} {sorted(only, key=repr)[:3]}; only there {len(other)} {sorted(other, key=repr)[:3]}"
    return None if got[1] else "no rows"
