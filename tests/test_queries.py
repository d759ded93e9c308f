"""Every registered mail query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from mailfunnel.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(found):
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(norm(v) for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({SQL[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)


def test_the_rest_runs(spark):
    for name, f in queries.queries().items():
        if name not in SQL:
            assert f(spark, DATA).limit(1).count() == 1
