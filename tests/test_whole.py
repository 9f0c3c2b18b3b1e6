"""The _whole queries read every row of the smallest tables; those of the same name without it do not."""

import os

import pytest
from loomstone.plans import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name, every", [("b_not_strict_whole", "region nation supplier customer part documents"), ("m_insert_whole", "part")])
def test_no_row_is_left_out(spark, name, every):
    got = {r["entity_id"] for r in catalog.queries()[name](spark, DIR).collect()}
    table = {t: spark.read.parquet(f"{DIR}/{t}.parquet") for t in every.split()}
    branded = table["part"].where("p_brand = 'Brand#2'").count() if name.startswith("b_") else 0
    assert len(got) == sum(t.count() for t in table.values()) - branded


def test_store_takes_the_last_digit(spark):
    got = {r["entity_id"] for r in catalog.queries()["m_store_whole"](spark, DIR).collect()}
    parts = {30_000_000 + r[0] for r in spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey").collect()}
    assert got == {i for i in parts if i % 10 not in (0, 7)}
