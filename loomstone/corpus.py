"""A corpus: the entity frame and the index frames that derive from it.

Index frames are lazy projections; ``indexed`` writes them once as Parquet, so that searches scan a few flat columns and
push their predicates down."""

from __future__ import annotations

from functools import cached_property

from loomstone.functions.text import normalize, normalize_text, tokens, value_text
from loomstone.schema import conform
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Index frames, and what each is looked up by (a pair begins with its key).
ORDER = {"aliases": "alias", "tokens": "token", "tags": "tag", "sources": "source", "attributes": "pair", "attribute_terms": "term", "relationships": "target_id", "names": "entity_id"}
INDEXES = tuple(ORDER)


class Corpus:
    def __init__(self, entities: DataFrame, plain: DataFrame | None = None):
        """plain: the same entities, but perhaps without relationships, if that is cheaper to make; all index frames but
        that of relationships derive from it."""
        self.entities = conform(entities)
        self.plain = self.entities if plain is None else conform(plain)
        self.spark = entities.sparkSession

    @cached_property
    def aliases(self) -> DataFrame:
        """One row per occurrence: entity_id, ord, pos, alias_raw, alias."""
        e = self.plain.select("entity_id", "ord", F.posexplode("aliases").alias("pos", "alias_raw"))
        return e.withColumn("alias", normalize("alias_raw"))

    @cached_property
    def tokens(self) -> DataFrame:
        """One row per occurrence: entity_id, token."""
        return self.aliases.select("entity_id", F.explode(tokens("alias")).alias("token"))

    @cached_property
    def tags(self) -> DataFrame:
        return self.plain.select("entity_id", F.explode(F.array_distinct(F.transform("tags", normalize))).alias("tag"))

    @cached_property
    def sources(self) -> DataFrame:
        return self.plain.select("entity_id", F.explode(F.array_distinct(F.transform("sources", lambda s: normalize(s["provider"])))).alias("source"))

    @cached_property
    def attributes(self) -> DataFrame:
        """entity_id, pos, key, vtype, s, i, d, b, v_norm, pair."""
        a = self.plain.select("entity_id", F.posexplode("attributes").alias("pos", "a")).select("entity_id", "pos", normalize(F.col("a.key")).alias("key"), "a.vtype", "a.s", "a.i", "a.d", "a.b")
        a = a.withColumn("v_norm", value_text(F.col("vtype"), F.col("s"), F.col("i"), F.col("d"), F.col("b")))
        return a.withColumn("pair", normalize(F.concat("key", F.lit(":"), "v_norm")))

    @cached_property
    def attribute_terms(self) -> DataFrame:
        """Whole values and their words: entity_id, term."""
        return self.attributes.select("entity_id", F.explode(F.array_union(F.array("v_norm"), tokens("v_norm"))).alias("term"))

    @cached_property
    def relationships(self) -> DataFrame:
        r = self.entities.select("entity_id", F.posexplode("relationships").alias("pos", "r"))
        return r.select("entity_id", "pos", normalize(F.col("r.kind")).alias("kind"), F.col("r.target").alias("target_id"))

    @cached_property
    def names(self) -> DataFrame:
        """The display name: the first alias."""
        return self.plain.select("entity_id", F.when(F.size("aliases") > 0, F.col("aliases")[0]).alias("name"))

    def indexed(self, path: str, entities: DataFrame | None = None) -> Corpus:
        """This corpus with its index frames written under path. entities: where these are written already; else they are
        written too, first, and the frames derive from them. Files hold ranges of what is looked up, in its order, so a
        lookup reads few of them."""
        if entities is None:
            self.entities.write.mode("overwrite").parquet(f"{path}/entities")
            entities = self.spark.read.parquet(f"{path}/entities")
        written = Corpus(entities)
        for name, key in ORDER.items():
            by = (key,) if key == "entity_id" else (key, "entity_id")
            getattr(written, name).repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/{name}")
        return Corpus.at(self.spark, path, entities)

    @classmethod
    def at(cls, spark, path: str, entities: DataFrame | None = None) -> Corpus:
        out = cls(spark.read.parquet(f"{path}/entities") if entities is None else entities)
        for name in INDEXES:
            out.__dict__[name] = spark.read.parquet(f"{path}/{name}")
        return out

    def changed(self, touched: DataFrame, entities: DataFrame) -> Corpus:
        """This corpus after the entities of some ids (touched, distinct) have become what they are in entities, or have gone.
        Index frames of all others stay as they are."""
        fresh = Corpus(entities.join(touched, "entity_id", "left_semi"))
        out = Corpus(entities)
        for name in INDEXES:
            out.__dict__[name] = getattr(self, name).join(touched, "entity_id", "left_anti").unionByName(getattr(fresh, name))
        return out

    def entity(self, entity_id: int) -> DataFrame:
        return self.entities.where(F.col("entity_id") == entity_id)

    def registered(self, kind: str, name: str | None = None, number: int | None = None) -> DataFrame:
        """The row of a registry by name or by id."""
        r = self.registry(kind)
        return r.where(F.col("name") == normalize_text(name)) if name is not None else r.where(F.col("id") == number)

    def registry(self, kind: str) -> DataFrame:
        """id and name of all tags, sources, attribute_keys or relationship_types, numbered in the order in which they first
        appear. One row per name is ordered in one task; these are vocabularies."""
        e = self.entities
        lists = {
            "tags": (F.col("tags"), lambda x: x), "sources": (F.col("sources"), lambda x: x["provider"]),
            "attribute_keys": (F.col("attributes"), lambda x: x["key"]), "relationship_types": (F.col("relationships"), lambda x: x["kind"]),
        }
        array, name = lists[kind]
        seen = e.select("ord", "entity_id", F.posexplode(F.transform(array, name)).alias("pos", "name")).select(normalize("name").alias("name"), F.struct("ord", "entity_id", "pos").alias("at"))
        first = seen.groupBy("name").agg(F.min("at").alias("at"))
        return first.select((F.row_number().over(W.orderBy("at")) - 1).cast("int").alias("id"), "name")

    def stats(self) -> DataFrame:
        """One row of counts: one pass over the entities, whose terms are counted by kind and name, then by kind."""
        alias = F.transform("aliases", normalize)
        of = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
        terms = F.concat(
            of("entity", F.array(F.lit(""))), of("alias", alias), of("token", F.flatten(F.transform(alias, tokens))), of("tag", F.transform("tags", normalize)),
            of("source", F.transform("sources", lambda x: normalize(x["provider"]))), of("attribute", F.transform("attributes", lambda x: normalize(x["key"]))),
            of("relationship", F.transform("relationships", lambda x: normalize(x["kind"]))),
        )
        n = self.entities.select(F.explode(terms).alias("t")).groupBy("t.kind", "t.name").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(F.count("name").alias("names"), F.sum("n").alias("n"))
        pick = lambda kind, c, to: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).alias(to)
        return n.agg(
            pick("entity", "n", "entities"), pick("tag", "names", "tags"), pick("source", "names", "sources"), pick("attribute", "names", "attributes"), pick("relationship", "names", "relationship_types"),
            pick("alias", "names", "aliases"), pick("alias", "names", "trie"), pick("alias", "n", "fuzzy_aliases"), pick("token", "names", "tokens"), pick("relationship", "n", "relationships"),
        )
