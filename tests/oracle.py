"""Compares a query with its SQL on the small tables."""

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 7) if v == v else "nan"
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    want = con.sql(sql)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
    assert got == sorted(str([_plain(r[i]) for i in at]) for r in want.fetchall())
