"""a_batch searches every kind of entity: a supplier, customer and region named as a part are found under its name."""

import os

import pytest
from loomstone.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_other_kinds_are_found(spark, tmp_path):
    import pyarrow.parquet as pq

    for f in os.listdir(DIR):
        os.symlink(f"{DIR}/{f}", tmp_path / f)
    name = pq.read_table(f"{DIR}/part.parquet")["p_name"][0].as_py()
    ids = {}
    for t, column, key, base in (("supplier", "s_name", "s_suppkey", 10_000_000), ("customer", "c_name", "c_custkey", 20_000_000), ("region", "r_name", "r_regionkey", 0)):
        rows = pq.read_table(f"{DIR}/{t}.parquet")
        values = rows[column].to_pylist()
        values[0] = name
        os.remove(tmp_path / f"{t}.parquet")
        pq.write_table(rows.set_column(rows.column_names.index(column), column, [values]), tmp_path / f"{t}.parquet")
        ids[t] = base + rows[key][0].as_py()
    found = catalog.queries()["a_batch"](spark, str(tmp_path)).where(f"query_id = '{name}'").collect()
    assert set(ids.values()) <= {r["entity_id"] for r in found}
