import os

import duckdb
import pytest

from rimefield.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, con, name):
    a, b = catalog.QUERIES[name](spark, DATA).toPandas(), con.sql(catalog.SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
