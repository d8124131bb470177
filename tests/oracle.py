"""Compares queries with their SQL over the same tables."""

import datetime
import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def differences(spark, sf_dir, query, sql, con=None):
    """A few rows that only one side has, and the columns where these differ."""
    df = query(spark, sf_dir)
    cur = (con or connect(sf_dir)).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(names), sorted(df.columns))]
    ours, theirs = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    return [] if ours == theirs else [("rows", len(ours), len(theirs)), *sorted(set(ours) ^ set(theirs), key=repr)[:4]]
