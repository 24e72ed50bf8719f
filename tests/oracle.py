"""Rows of a Spark result and of the oracle's SQL, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int | float):
        return float(f"{float(x):.9g}")
    return str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())


def oracle_rows(con, sql):
    r = con.sql(sql)
    return sorted(r.columns), rows(r.columns, r.fetchall())
