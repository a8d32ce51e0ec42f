"""Comparison of a query's rows with those of its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    d = c.execute(sql)
    names = [x[0] for x in d.description]
    return names, d.fetchall()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def same(df, sql, sf):
    names, data = sql_rows(sql, sf)
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(names, data)
    norm = lambda rs: sorted((tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r) for r in rs), key=repr)
    assert norm(got) == norm(want)
