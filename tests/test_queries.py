"""Every query against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from axisloom import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, tables, name):
    got = queries.queries()[name](spark, DATA).toPandas()
    want = tables.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9, atol=1e-9)
