"""Every query with SQL equals it in DuckDB at the smallest scale."""

import math

import duckdb
import pytest

from tidewater.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=key)
    assert a == b
