"""Run a query and its SQL over the same tables and compare rows, columns by name."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(names)


def differences(spark, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    mine, my_names = rows_of(df.columns, df.collect())
    con = con or views(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs, their_names = rows_of(names, got.fetchall())
    if my_names != their_names:
        return f"columns {my_names} {their_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
