"""Schemas, weights and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = "array<struct<provider:string,verified:boolean,created:bigint,updated:bigint>>"
RELATIONSHIPS = "array<struct<target:bigint,kind:string>>"
TYPED = "array<struct<key:string,vtype:string,s:string,i:bigint,d:double,b:boolean>>"
#: What comes in: attribute values are texts.
ENTITY_INPUT = f"id bigint, aliases array<string>, tags array<string>, attributes array<struct<key:string,value:string>>, relationships {RELATIONSHIPS}, sources {SOURCES}"
#: What is kept: attribute values are typed, ``ord`` is the order of insertion (kept by updates).
ENTITY = f"entity_id bigint, ord bigint, aliases array<string>, tags array<string>, attributes {TYPED}, relationships {RELATIONSHIPS}, sources {SOURCES}"
LISTS = ("aliases", "tags", "attributes", "relationships", "sources")
LARGEST_ID = 2**32 - 1

#: What a match by each signal counts, in hundredths.
WEIGHTS = {
    "ExactAlias": 100,
    "AttributeKeyValue": 85,
    "PrefixAlias": 75,
    "Relationship": 70,
    "FuzzyAlias": 60,
    "AttributeValue": 50,
    "Source": 45,
    "Token": 40,
    "Tag": 25,
    "AttributeKey": 20,
}
#: Fixed value: what each further signal adds, in hundredths.
BONUS = 3


def typed_attributes(attributes: Column | str, infer_types: bool = False) -> Column:
    """Text attributes as typed ones. By default all are strings; ``infer_types`` reads whole numbers, decimals and booleans."""

    def one(a: Column) -> Column:
        v = a["value"]
        if not infer_types:
            kind, i, d, b = F.lit("string"), F.lit(None), F.lit(None), F.lit(None)
        else:
            i, d, b = v.try_cast("bigint"), v.try_cast("double"), F.when(F.lower(v).isin("true", "false"), F.lower(v) == "true")
            kind = F.when(i.isNotNull() & v.rlike(r"^[+-]?\d+$"), "integer").when(b.isNotNull(), "boolean").when(d.isNotNull() & v.rlike(r"^[+-]?\d+\.\d+$"), "float").otherwise("string")
            i, d, b = F.when(kind == "integer", i), F.when(kind == "float", d), F.when(kind == "boolean", b)
        return F.struct(a["key"].alias("key"), kind.alias("vtype"), F.when(kind == "string", v).alias("s"), i.cast("bigint").alias("i"), d.cast("double").alias("d"), b.cast("boolean").alias("b"))

    return F.transform(attributes, one)


def conform(entities: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A frame with some of the columns of ENTITY as one with all of them; lists that lack are empty. keep: further columns,
    which come first."""
    kinds = {"aliases": "array<string>", "tags": "array<string>", "attributes": TYPED, "relationships": RELATIONSHIPS, "sources": SOURCES}
    lists = [F.coalesce(F.col(c).cast(k), F.array().cast(k)).alias(c) if c in entities.columns else F.array().cast(k).alias(c) for c, k in kinds.items()]
    order = F.col("ord") if "ord" in entities.columns else F.col("entity_id")
    return entities.select(*keep, F.col("entity_id").cast("bigint").alias("entity_id"), order.cast("bigint").alias("ord"), *lists)
