"""Compare a query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, data, f, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = f(spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    rows = con.execute(sql)
    names = [c[0] for c in rows.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows.fetchall())
    assert got == want
