"""The star-schema tables as one corpus of entities."""

from __future__ import annotations

from functools import reduce

from loomstone.schema import RELATIONSHIPS, SOURCES, TYPED, conform
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _texts(*columns):
    return F.array(*[F.lit(c[1:]) if isinstance(c, str) and c[0] == "=" else F.col(c) if isinstance(c, str) else c for c in columns])


def _attribute(key: str, kind: str, column: str):
    v = {k: F.lit(None) for k in ("s", "i", "d", "b")} | {{"string": "s", "integer": "i", "float": "d"}[kind]: F.col(column)}
    return F.struct(F.lit(key).alias("key"), F.lit(kind).alias("vtype"), v["s"].cast("string").alias("s"), v["i"].cast("bigint").alias("i"), v["d"].cast("double").alias("d"), v["b"].cast("boolean").alias("b"))


def entities(spark: SparkSession, sf_dir: str, only: tuple[str, ...] | None = None, makers: bool = True) -> DataFrame:
    """The entities of these tables (all by default). makers: whether parts are related to their suppliers, which takes an
    aggregation of line items."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = {"attributes": F.array().cast(TYPED), "relationships": F.array().cast(RELATIONSHIPS)}

    def of(df: DataFrame, entity_id, aliases, tags, attributes=None, target=None, kind=None, provider=None) -> DataFrame:
        links = F.when(target.isNotNull(), F.array(F.struct(target.cast("bigint").alias("target"), F.lit(kind).alias("kind")))).otherwise(F.array()) if target is not None else none["relationships"]
        source = F.array(F.struct((provider if provider is not None else F.lit("tpch")).alias("provider"), F.lit(False).alias("verified"), F.lit(None).cast("bigint").alias("created"), F.lit(None).cast("bigint").alias("updated")))
        return df.select(
            entity_id.cast("bigint").alias("entity_id"), entity_id.cast("bigint").alias("ord"), aliases.alias("aliases"), tags.alias("tags"),
            (F.array(*attributes) if attributes else none["attributes"]).cast(TYPED).alias("attributes"), links.cast(RELATIONSHIPS).alias("relationships"), source.cast(SOURCES).alias("sources"),
        )

    def part() -> DataFrame:
        maker = read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("maker"))
        p = read("part").join(maker, "p_partkey", "left") if makers else read("part").withColumn("maker", F.lit(None).cast("bigint"))
        return of(
            p, 30_000_000 + F.col("p_partkey"), F.array("p_name", F.concat_ws(" ", "p_brand", "p_name")), _texts("=part", "p_type"),
            [_attribute("brand", "string", "p_brand"), _attribute("size", "integer", "p_size"), _attribute("retailprice", "float", "p_retailprice")],
            10_000_000 + F.col("maker"), "made_by",
        )

    kinds = {
        "region": lambda: of(read("region"), F.col("r_regionkey"), _texts("r_name"), _texts("=region")),
        "nation": lambda: of(read("nation"), 1000 + F.col("n_nationkey"), _texts("n_name"), _texts("=nation"), None, F.col("n_regionkey"), "part_of"),
        "supplier": lambda: of(read("supplier"), 10_000_000 + F.col("s_suppkey"), _texts("s_name"), _texts("=supplier"), [_attribute("acctbal", "float", "s_acctbal")], 1000 + F.col("s_nationkey"), "located_in"),
        "customer": lambda: of(read("customer"), 20_000_000 + F.col("c_custkey"), _texts("c_name"), _texts("=customer", "c_mktsegment"), [_attribute("acctbal", "float", "c_acctbal")], 1000 + F.col("c_nationkey"), "located_in"),
        "part": part,
        "document": lambda: of(read("documents"), 40_000_000 + F.col("doc_id"), F.array(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))), _texts("=document", "lang"), [_attribute("n_chars", "integer", "n_chars")], None, None, F.col("source")),
    }
    return conform(reduce(DataFrame.unionByName, [make() for name, make in kinds.items() if only is None or name in only]))
