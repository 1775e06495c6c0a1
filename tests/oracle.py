"""A query's rows against DuckDB's answer to its SQL, as bags, by column name."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


def views():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in os.listdir(DATA):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{DATA}/{p}'")
    return con


def check(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    res = con.sql(sql)
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in res.fetchall())
