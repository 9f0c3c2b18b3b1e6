"""Filter search: boolean expressions over attributes and relationships, and unranked name stages word by word.

A candidate frame is (entity_id, signals), signals an array that may repeat. An expression with attribute leaves only is
one scan and one aggregation whatever its size; others are semi-joins and unions of leaves."""

from __future__ import annotations

from functools import reduce

from loomstone.corpus import Corpus
from loomstone.functions.text import Value, normalize_text
from loomstone.operators.search import FEW, fuzzy_pairs, matched_aliases, near, prefix_pairs, prefixed
from loomstone.plans.query import And, AttributeFilter, Not, Or, Plan, Query, RelationshipFilter, SourceFilter, TagFilter, leaves
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = "entity_id bigint, signals array<string>"


def compares(op: str, value: Value) -> Column:
    """Whether an attribute row (vtype, s, i, d, b) stands in this relation to a literal. Equality is within a type, texts
    normalized; order is within numbers or texts as they are; not-a-number is neither equal nor in any order."""
    kind = F.col("vtype")
    lit = F.lit(value.value)
    if value.kind == "string":
        equal, less, more, typed = F.col("v_norm") == normalize_text(value.value), F.col("s") < lit, F.col("s") > lit, kind == "string"
        ordered, same = typed, typed & equal
        at_most, at_least = F.col("s") <= lit, F.col("s") >= lit
    elif value.kind == "boolean":
        same, ordered = (kind == "boolean") & (F.col("b") == lit), F.lit(False)
        less = more = at_most = at_least = F.lit(False)
    else:
        number = F.when(kind == "float", F.col("d"))
        if value.kind == "integer":
            whole = F.col("i")
            by = lambda f: F.when(kind == "integer", f(whole, lit)).otherwise(f(number, lit.cast("double")))
        else:
            by = lambda f: f(F.coalesce(F.when(kind == "integer", F.col("i").cast("double")), number), lit)
        real = (kind == "integer") | ((kind == "float") & ~F.isnan("d"))
        if value.kind == "float" and value.value != value.value:
            real = F.lit(False)
        ordered = real
        same = real & (kind == value.kind) & by(lambda a, b: a == b)
        less, more = by(lambda a, b: a < b), by(lambda a, b: a > b)
        at_most, at_least = by(lambda a, b: a <= b), by(lambda a, b: a >= b)
    same = F.coalesce(same, F.lit(False))
    found = {"=": same, "!=": ~same, "<": ordered & less, ">": ordered & more, "<=": ordered & at_most, ">=": ordered & at_least}
    return F.coalesce(found.get(op, F.lit(False)), F.lit(False))


def attribute_entities(corpus: Corpus, key: str, op: str, value: Value) -> DataFrame:
    """Entities with any value of the key in this relation to a literal."""
    return corpus.attributes.where((F.col("key") == normalize_text(key)) & compares(op, value)).select("entity_id").distinct()


def _empty(corpus: Corpus) -> DataFrame:
    return corpus.spark.createDataFrame([], CANDIDATES)


def _signal(entities: DataFrame, signal: str) -> DataFrame:
    return entities.select("entity_id", F.array(F.lit(signal)).alias("signals"))


def _relationship(corpus: Corpus, leaf: RelationshipFilter) -> DataFrame:
    """The target is the first entity, in order of insertion, that has the alias; the kind is compared as written."""
    found = corpus.aliases.where(F.col("alias") == normalize_text(leaf.target))
    target = found.agg(F.min_by("entity_id", F.struct("ord", "entity_id", "pos")).alias("first"))
    r = corpus.relationships.where(F.col("kind") == leaf.kind).join(F.broadcast(target), F.col("target_id") == F.col("first"))  # one row
    return r.groupBy("entity_id").agg(F.collect_list(F.lit("Relationship")).alias("signals"))


def leaf_candidates(corpus: Corpus, leaf, extended: bool = False) -> DataFrame:
    if isinstance(leaf, AttributeFilter):
        return _signal(attribute_entities(corpus, leaf.key, leaf.op, leaf.value), "Property")
    if isinstance(leaf, RelationshipFilter):
        return _relationship(corpus, leaf)
    if extended and isinstance(leaf, TagFilter):
        return _signal(corpus.tags.where(F.col("tag") == normalize_text(leaf.tag)), "Tag")
    if extended and isinstance(leaf, SourceFilter):
        return _signal(corpus.sources.where(F.col("source") == normalize_text(leaf.source)), "Source")
    return _empty(corpus)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of either, their signals one after the other."""
    return a.unionByName(b).groupBy("entity_id").agg(F.flatten(F.collect_list("signals")).alias("signals"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of both with the signals of the first."""
    return a.join(b, "entity_id", "left_semi")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of both with the signals of both."""
    other = b.withColumnRenamed("signals", "more")
    return a.join(other, "entity_id").select("entity_id", F.concat("signals", "more").alias("signals"))


def evaluate(corpus: Corpus, expr, strict_not: bool = False) -> DataFrame:
    """Candidates of an expression. Negation gives none unless ``strict_not`` (then: all entities but the operand's)."""
    if all(isinstance(x, AttributeFilter) for x in leaves(expr)):
        return _one_pass(corpus, expr, strict_not)
    if isinstance(expr, And):
        return intersect(evaluate(corpus, expr.left, strict_not), evaluate(corpus, expr.right, strict_not))
    if isinstance(expr, Or):
        return union(evaluate(corpus, expr.left, strict_not), evaluate(corpus, expr.right, strict_not))
    if isinstance(expr, Not):
        if not strict_not:
            return _empty(corpus)
        return _signal(corpus.entities.join(evaluate(corpus, expr.inner, True), "entity_id", "left_anti"), "Not")
    return leaf_candidates(corpus, expr)


def _one_pass(corpus: Corpus, expr, strict_not: bool) -> DataFrame:
    """Each leaf as a flag per entity; an expression is the number of signals it gives, 0 for no match."""
    found = list(dict.fromkeys(leaves(expr)))
    name = {x: f"leaf_{i}" for i, x in enumerate(found)}
    flag = {x: (F.col("key") == normalize_text(x.key)) & compares(x.op, x.value) for x in found}

    def count(e) -> Column:
        if isinstance(e, And):
            return F.when((count(e.left) > 0) & (count(e.right) > 0), count(e.left)).otherwise(0)
        if isinstance(e, Or):
            return count(e.left) + count(e.right)
        if isinstance(e, Not):
            return F.when(count(e.inner) > 0, 0).otherwise(1) if strict_not else F.lit(0)
        return F.col(name[e]).cast("int")

    keys = sorted({normalize_text(x.key) for x in found})
    a = corpus.attributes.where(F.col("key").isin(keys)) if not strict_not else corpus.attributes
    if not strict_not:
        a = a.where(reduce(Column.__or__, flag.values()))
    flags = a.groupBy("entity_id").agg(*[F.bool_or(flag[x]).alias(name[x]) for x in found])
    if strict_not:
        flags = corpus.entities.select("entity_id").join(flags, "entity_id", "left").fillna(False, [name[x] for x in found])
    return flags.withColumn("n", count(expr)).where("n > 0").select("entity_id", F.array_repeat(F.lit("Property"), F.col("n")).alias("signals"))


def _words(query: Query) -> list[dict]:
    return [{"query_id": i, "q": t} for i, t in enumerate(query.tokens)]


def _word_frame(corpus: Corpus, query: Query) -> DataFrame:
    return corpus.spark.createDataFrame([(i, t) for i, t in enumerate(query.tokens)], "query_id bigint, q string")


def stage(corpus: Corpus, query: Query, kind: str, distance: int | None = None) -> DataFrame:
    """One row per match of a name stage: entity_id, signal. Exact compares the whole query, the others each word."""
    if kind == "ExactAlias":
        found = corpus.aliases.where(F.col("alias") == query.normalized).select("entity_id").distinct()
    elif not query.tokens:
        found = corpus.aliases.select("entity_id").limit(0)
    elif kind == "PrefixAlias":
        found = prefixed(corpus.aliases, _words(query)) if len(query.tokens) <= FEW else matched_aliases(corpus, prefix_pairs(corpus.aliases.select("alias").distinct(), _word_frame(corpus, query), False))
    elif kind == "FuzzyAlias":
        far = 1 if distance is None else distance
        found = near(corpus.aliases, _words(query), far) if len(query.tokens) <= FEW else matched_aliases(corpus, fuzzy_pairs(corpus.aliases.select("alias").distinct(), _word_frame(corpus, query), False, far))
    elif kind == "Token":
        found = corpus.tokens.where(F.col("token").isin(sorted(set(query.tokens)))).join(_word_frame(corpus, query), F.col("token") == F.col("q"))
    elif kind == "Tag":
        found = corpus.tags.where(F.col("tag").isin(sorted(set(query.tokens)))).join(_word_frame(corpus, query), F.col("tag") == F.col("q"))
    else:  # attribute and relationship stages do nothing without a filter
        found = corpus.aliases.select("entity_id").limit(0)
    return found.select("entity_id", F.lit(kind).alias("signal"))


def filter_search(corpus: Corpus, text: str, strict_not: bool = False) -> DataFrame:
    """Candidates of a query by its plan: those of its filter expression if it is one, else of its name stages."""
    query = Query.parse(text)
    if query.filter is not None:
        return evaluate(corpus, query.filter, strict_not)
    found = [stage(corpus, query, s.kind, s.distance) for s in Plan.of(query).stages]
    return reduce(DataFrame.unionByName, found).groupBy("entity_id").agg(F.array_sort(F.collect_list("signal")).alias("signals"))
