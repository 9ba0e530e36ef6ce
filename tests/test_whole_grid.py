import os

import duckdb
import pytest

from rimefield.plans import catalog

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", ["q_idw_fill", "q_gauss_smooth", "q_bilinear"])
def test_grid_takes_all_parts(spark, name):
    """The query's SQL without its filter on the id gives the same rows."""
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{DATA}/part.parquet'")
    want = con.sql(catalog.SQL[name].replace("WHERE p_partkey % 3 = 0", "")).fetchall()
    got = catalog.QUERIES[name](spark, DATA).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
