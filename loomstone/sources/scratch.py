"""The folder that driver and executors share, for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="loomstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def numbered(rows: DataFrame, path: str, name: str, *order: str) -> DataFrame:
    """rows with a column ``name``: 0, 1, 2 and so on in an order. They are written under path in ranges of that order, and numbered
    from the counts of the ranges, so none but these counts meet in one task."""
    laid = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid.write.mode("overwrite").parquet(path)
    laid = rows.sparkSession.read.schema(laid.schema).parquet(path)
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return laid.join(starts, part == F.col("_part")).withColumn(name, F.col("_before") + F.expr("_at & 8589934591L")).drop("_at", "_part", "_before")
