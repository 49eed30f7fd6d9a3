"""Runs a query and its SQL over tables and compares all rows."""

import os
from collections import Counter

import duckdb

TABLES = "documents pages benchmark labels conversations embeddings".split()


def same_as_sql(spark, name, query, sql, folder):
    connection = duckdb.connect()
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = connection.execute(sql)
    columns = sorted(c[0] for c in want.description)
    rows = [dict(zip((c[0] for c in want.description), r, strict=True)) for r in want.fetchall()]
    got = query(spark, folder)
    assert sorted(got.columns) == columns, name
    told = lambda x: round(x, 6) if isinstance(x, float) else x
    key = lambda r: tuple(repr(told(r[c])) for c in columns)
    found, wanted = sorted(map(key, (r.asDict() for r in got.collect()))), sorted(map(key, rows))
    assert len(found) == len(wanted), name
    apart = Counter(found) - Counter(wanted), Counter(wanted) - Counter(found)
    assert found == wanted, (name, len(apart[0]), *(next(iter(x)) for x in apart))
