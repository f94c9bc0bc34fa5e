"""Every query with SQL gives DuckDB's rows; the others give some."""

import math

import duckdb
import pytest

from epistema.catalogue import every

QUERIES, SQL = every()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def order(row):
    return tuple((x is not None, "" if isinstance(x, int | float) else str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    if key not in SQL:
        assert got
        return
    rel = duck.sql(SQL[key])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=2e-5) if isinstance(x, float) and isinstance(y, int | float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
