"""What is registered, and the queries that SQL can express against DuckDB on the smallest tables, where those are there."""

import os
import re

import pytest
from loomstone.llm import registry

DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_duckdb(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = registry.queries()[name](spark, DIR)
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    key = lambda rows: sorted((tuple(map(near, r)) for r in rows), key=repr)
    assert key(df.select(*columns).collect()) == key(want.fetchall())
