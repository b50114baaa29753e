"""Compares a query with its SQL in DuckDB over the same tables."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}/*.parquet" if os.path.isdir(f"{DATA}/{name}") else f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(spark, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    result = connect().execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want
