"""Every query with an SQL form gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from chronosift import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(data):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    have = [c[0] for c in r.description]
    assert sorted(have) == cols
    want = [tuple(x[have.index(c)] for c in cols) for x in r.fetchall()]
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
