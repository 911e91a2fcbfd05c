"""Runs a query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return str(value.isoformat())
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "float", round(v, 4)) for v in r))


def compare(spark, folder, query, sql):
    frame = query(spark, folder)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection(folder).execute(sql)
    want = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (a, b)
    return len(got[1])


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
