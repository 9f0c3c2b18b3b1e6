"""Entities from JSON files."""

from __future__ import annotations

from loomstone.errors import InvalidFormat
from loomstone.schema import ENTITY_INPUT, LARGEST_ID, LISTS, RELATIONSHIPS, SOURCES, conform, typed_attributes
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_entities(spark: SparkSession, path: str, infer_types: bool = False, check: bool = True) -> DataFrame:
    """A JSON array of entities; all six fields are needed and unknown ones are ignored. An entity's place in the file
    gives its order."""
    raw = spark.read.schema(ENTITY_INPUT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _entities(raw, infer_types, check, ("id", *LISTS))


def read_build_input(spark: SparkSession, path: str, infer_types: bool = False) -> DataFrame:
    """The lenient form for bulk building: ``names`` or ``aliases``, and any other list may lack."""
    schema = f"id bigint, names array<string>, aliases array<string>, tags array<string>, attributes array<struct<key:string,value:string>>, relationships {RELATIONSHIPS}, sources {SOURCES}"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raw = raw.withColumn("aliases", F.coalesce("names", "aliases")).drop("names")
    return _entities(raw, infer_types, True, ("id", "aliases"))


def _entities(raw: DataFrame, infer_types: bool, check: bool, needed: tuple[str, ...]) -> DataFrame:
    if check:
        lacking = F.lit(False)
        for c in needed:
            lacking |= F.col(c).isNull()
        bad = lacking | (F.col("id") < 0) | (F.col("id") > LARGEST_ID)
        if found := raw.where(bad).limit(1).collect():
            raise InvalidFormat(f"an entity lacks a field or has an id out of range: {found[0].asDict()}")
    e = raw.withColumn("ord", F.monotonically_increasing_id()).withColumnRenamed("id", "entity_id")
    empty = F.array().cast("array<struct<key:string,value:string>>")
    return conform(e.withColumn("attributes", typed_attributes(F.coalesce("attributes", empty), infer_types)))
