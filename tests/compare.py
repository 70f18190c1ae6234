"""Runs a query and its oracle over the same tables and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def _plain(v):
    if isinstance(v, float) and not math.isnan(v):
        return float(f"{v:.12g}") + 0.0
    return v


def same(df, sql, folder):
    names, want = oracle_rows(sql, folder)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    got = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(_plain(r[k]) for k in at) for r in want]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (order, len(bad), bad[:3])
    assert got, "no rows"
