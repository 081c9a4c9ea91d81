"""A query against its SQL in DuckDB, rows compared without regard to order."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def differences(spark, run, sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(str(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    theirs = Counter(tuple(str(x) for x in r) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall())
    return list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
