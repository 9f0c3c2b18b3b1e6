"""Single lookups of the index frames."""

from __future__ import annotations

from loomstone.corpus import Corpus
from loomstone.functions.text import Value, normalize_text
from loomstone.operators.filters import attribute_entities
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(corpus: Corpus, alias: str) -> DataFrame:
    """Entities with exactly this alias, in the order in which they were inserted."""
    found = corpus.aliases.where(F.col("alias") == normalize_text(alias)).groupBy("entity_id").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return found.orderBy("at").select("entity_id")


def by_prefix(corpus: Corpus, text: str) -> DataFrame:
    return corpus.aliases.where(F.col("alias").startswith(normalize_text(text))).select("entity_id").distinct()


def by_distance(corpus: Corpus, text: str, distance: int) -> DataFrame:
    return corpus.aliases.where(F.levenshtein("alias", F.lit(normalize_text(text)), distance) >= 0).select("entity_id").distinct()


def by_token(corpus: Corpus, token: str) -> DataFrame:
    return corpus.tokens.where(F.col("token") == normalize_text(token)).select("entity_id").distinct()


def with_tag(corpus: Corpus, tag: str) -> DataFrame:
    return corpus.tags.where(F.col("tag") == normalize_text(tag)).select("entity_id")


def with_source(corpus: Corpus, source: str) -> DataFrame:
    return corpus.sources.where(F.col("source") == normalize_text(source)).select("entity_id")


def with_attribute(corpus: Corpus, key: str, value: str) -> DataFrame:
    pair = normalize_text(f"{normalize_text(key)}:{normalize_text(value)}")
    return corpus.attributes.where(F.col("pair") == pair).select("entity_id").distinct()


def compare_attribute(corpus: Corpus, key: str, op: str, value: Value) -> DataFrame:
    return attribute_entities(corpus, key, op, value)


def attribute_differs(corpus: Corpus, key: str, value: Value) -> DataFrame:
    """Entities that have the key and no value equal to this one, texts compared as they are."""
    column = {"string": "s", "integer": "i", "float": "d", "boolean": "b"}[value.kind]
    same = (F.col("vtype") == value.kind) & F.col(column).eqNullSafe(F.lit(value.value))
    if value.kind == "float":
        same &= ~F.isnan("d")
    a = corpus.attributes.where(F.col("key") == normalize_text(key))
    return a.groupBy("entity_id").agg(F.bool_or(same).alias("any")).where("not any").select("entity_id")


def relationships_of(corpus: Corpus, entity_id: int, kind: str | None = None) -> DataFrame:
    r = corpus.relationships.where(F.col("entity_id") == entity_id)
    return r if kind is None else r.where(F.col("kind") == normalize_text(kind))


def related_to(corpus: Corpus, target_id: int) -> DataFrame:
    """Relationships that point to an entity."""
    return corpus.relationships.where(F.col("target_id") == target_id)


def with_relationship(corpus: Corpus, kind: str, target_id: int) -> DataFrame:
    """kind: as stored, that is normalized."""
    return corpus.relationships.where((F.col("kind") == kind) & (F.col("target_id") == target_id)).select("entity_id")
