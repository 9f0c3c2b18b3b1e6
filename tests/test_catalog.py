"""Registered queries against DuckDB on the smallest tables, where those are there."""

import os

import pytest
from loomstone.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = catalog.queries()[name](spark, DIR)
    want = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    assert key(df.select(*columns).collect()) == key(want.fetchall())
