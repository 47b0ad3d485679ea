"""Registered queries against their DuckDB SQL."""

from __future__ import annotations

import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in found)


def check(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    assert got == rows([d[0] for d in answer.description], answer.fetchall())
