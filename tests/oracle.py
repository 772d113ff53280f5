"""Compares a query with its SQL as the driver does: same columns, same rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def expected(sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def same(df, sql, sf_dir=SF):
    names, want = expected(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in at) for r in want)
    assert got == want, ([x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3], len(got), len(want))
