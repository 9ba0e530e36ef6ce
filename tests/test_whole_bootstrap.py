import os

import duckdb
import pytest

from rimefield.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_bootstrap_draws_500_times(spark):
    """The query's SQL with the reference's 500 draws, and as many blocks as there are, gives the same rows."""
    con = duckdb.connect()
    for name in ("lineitem", "supplier", "nation"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    sql = catalog.SQL["q_block_bootstrap"].replace("range(100) a(rep)", "range(500) a(rep)").replace("range(20) b(k) WHERE k < n.nb", "range(n.nb) b(k)")
    want = con.sql(sql).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["q_block_bootstrap"](spark, DATA).collect())) == sorted(want)
