"""Ranked search: ten signals of a whole query, added up per entity and explained.

All queries of a batch are searched at once. Equality signals are joins on normalized text, whose sides Catalyst
broadcasts or shuffles by their sizes; of few queries (given as text, at most ``FEW``) the texts are literals in a predicate
as well, which prunes the scan of an index frame. Prefix and fuzzy matches have two forms with equal results: few queries are
tried on every alias, with the heads in a predicate and no join at all; any number of them meets prefixes, or what is left of
texts without a character or two, in equality joins."""

from __future__ import annotations

from functools import reduce

from loomstone.corpus import Corpus
from loomstone.errors import InvalidInput
from loomstone.functions.text import normalize
from loomstone.plans.query import OPERATORS
from loomstone.schema import BONUS, WEIGHTS
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEW = 256
#: Largest edit distance for a frame of queries: shapes of a text grow as the power of its length to this.
MOST_DISTANCE = 2
LOTS = 64
EXPLANATION = "struct<kind:string,term:string,key:string,value:string,target:bigint>"


def query_frame(corpus: Corpus, queries) -> tuple[DataFrame, list | None]:
    """query_id, raw, q, key, value of a text, a list of texts, or a frame (query_id, query); and these rows, if they are few."""
    if isinstance(queries, DataFrame):
        df, few = queries.select("query_id", F.col("query").alias("raw")), False
    else:
        texts = [queries] if isinstance(queries, str) else list(queries)
        df, few = corpus.spark.createDataFrame(list(enumerate(texts)), "query_id bigint, raw string"), len(texts) <= FEW
    pair = attribute_query("raw")
    df = df.withColumn("q", normalize("raw")).withColumn("pair", pair)
    df = df.select("query_id", "raw", "q", normalize(F.col("pair.key")).alias("key"), normalize(F.col("pair.value")).alias("value"))
    df = df.withColumn("wanted", normalize(F.concat("key", F.lit(":"), "value")))
    return df, df.collect() if few else None  # a local relation: no job


def _among(index: DataFrame, column: str, asked: list | None, name: str = "q", plain: bool = False) -> DataFrame:
    """The rows of an index frame that a few literal queries can match, by a predicate that reaches the scan."""
    if asked is None:
        return index
    values = sorted({r[name] for r in asked if r[name] is not None and not (plain and r["key"] is not None)})
    return index.where(F.col(column).isin(values)) if values else index.where(F.lit(False))


def attribute_query(raw: str) -> Column:
    """struct(key, value) of a query like key OP value, else null; see plans.query.parse_attribute_query."""
    r = F.col(raw)

    def split(op: str) -> Column:
        at = F.instr(r, op)
        return F.when((at > 1) & (F.length(r) >= at + len(op)), F.struct(F.substr(r, F.lit(1), at - 1).alias("key"), F.substr(r, at + len(op)).alias("value")))

    return F.coalesce(*map(split, OPERATORS))


def _hit(df: DataFrame, signal: str, term: Column | None = None, key: Column | None = None, value: Column | None = None, target: Column | None = None) -> DataFrame:
    none = F.lit(None)
    x = [F.lit(signal).alias("kind"), *[(none if c is None else c).cast(t).alias(n) for n, t, c in (("term", "string", term), ("key", "string", key), ("value", "string", value), ("target", "bigint", target))]]
    return df.select("query_id", "entity_id", F.lit(signal).alias("source"), F.struct(*x).alias("explanation"))


def exact(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    return _hit(_among(corpus.aliases, "alias", asked).join(q, F.col("alias") == F.col("q")), "ExactAlias", F.col("q"))


def token(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    return _hit(_among(corpus.tokens, "token", asked).join(q, F.col("token") == F.col("q")), "Token", F.col("q"))


def tag(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    return _hit(_among(corpus.tags, "tag", asked).join(q, F.col("tag") == F.col("q")), "Tag", F.col("q"))


def source(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    return _hit(_among(corpus.sources, "source", asked).join(q, F.col("source") == F.col("q")), "Source", F.col("q"))


def attribute_pair(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    """The operator of the query is not looked at: key and value must be equal."""
    wanted = q.where("key is not null").withColumnsRenamed({"key": "q_key", "value": "q_value"})
    found = _among(corpus.attributes, "pair", asked, "wanted")
    return _hit(found.join(wanted, F.col("pair") == F.col("wanted")), "AttributeKeyValue", key=F.col("q_key"), value=F.col("q_value"))


def attribute_key(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    plain = q.where("key is null").select("query_id", "q")
    return _hit(_among(corpus.attributes, "key", asked, plain=True).join(plain, F.col("key") == F.col("q")), "AttributeKey", F.col("q"))


def attribute_value(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    plain = q.where("key is null").select("query_id", "q")
    return _hit(_among(corpus.attribute_terms, "term", asked, plain=True).join(plain, F.col("term") == F.col("q")), "AttributeValue", F.col("q"))


def relationship(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    """Entities related, in any way, to an entity that has the query as an alias."""
    targets = _among(corpus.aliases, "alias", asked).join(q, F.col("alias") == F.col("q")).select("query_id", F.col("entity_id").alias("found")).distinct()
    return _hit(corpus.relationships.join(targets, F.col("target_id") == F.col("found")), "Relationship", F.col("kind"), target=F.col("target_id"))


def _literals(asked: list) -> Column:
    """The queries as an array of structs (query_id, q)."""
    kind = "array<struct<query_id:bigint,q:string>>"
    return F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["q"]).alias("q")) for r in asked]).cast(kind)


def prefixed(aliases: DataFrame, asked: list) -> DataFrame:
    """Rows of aliases and each of a few literal queries that the alias begins with, as query_id and q. Heads reach the scan."""
    heads = sorted({r["q"] for r in asked if r["q"] is not None})
    if not heads:
        return aliases.withColumns({"query_id": F.lit(0).cast("bigint"), "q": F.lit("")}).limit(0)
    some = aliases.where(reduce(Column.__or__, [F.col("alias").startswith(h) for h in heads]))
    hit = F.filter(_literals(asked), lambda s: F.startswith(F.col("alias"), s["q"]))
    return some.withColumn("s", F.explode(hit)).select(*aliases.columns, "s.query_id", "s.q")


def near(aliases: DataFrame, asked: list, distance: int) -> DataFrame:
    """Rows of aliases and each of a few literal queries within an edit distance, as query_id and q."""
    close = lambda s: (F.abs(F.length("alias") - F.length(s["q"])) <= distance) & (F.levenshtein(F.col("alias"), s["q"], distance) >= 0)
    return aliases.withColumn("s", F.explode(F.filter(_literals(asked), close))).select(*aliases.columns, "s.query_id", "s.q")


def matched_aliases(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """From (query_id, q, alias) to the entities that have the alias."""
    return corpus.aliases.join(pairs.withColumnRenamed("alias", "matched"), F.col("alias") == F.col("matched"))


def prefix_pairs(aliases: DataFrame, q: DataFrame, few: bool) -> DataFrame:
    """Distinct (query_id, q, alias) with an alias that begins with q. aliases: distinct aliases; few: whether the queries are
    few enough to be literals. Of any number of queries, only heads of a length that some query has are made."""
    if few:
        return prefixed(aliases, q.select("query_id", "q").collect()).select("query_id", "q", "alias")
    own = q.select("query_id", "q").where("q <> ''")
    lengths = own.agg(F.array_sort(F.collect_set(F.length("q"))).alias("lengths"))  # one row
    cut = aliases.where("alias <> ''").crossJoin(F.broadcast(lengths)).select("alias", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("alias")), lambda n: F.substr("alias", F.lit(1), n))).alias("head"))
    # empty queries match all aliases: these go in lots
    every = q.where("q = ''").select("query_id", "q", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))).alias("lot"))
    whole = aliases.withColumn("lot", F.pmod(F.xxhash64("alias"), F.lit(LOTS)).cast("int")).join(every, "lot").select("query_id", "q", "alias")
    return cut.join(own, F.col("head") == F.col("q")).select("query_id", "q", "alias").unionByName(whole)


def _shapes(text: str, distance: int) -> Column:
    """A text and what is left of it without up to so many of its characters."""
    shorter = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))).otherwise(F.array().cast("array<string>"))
    found = F.array(F.col(text))
    for _ in range(distance):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
    return F.explode(found)


def fuzzy_pairs(aliases: DataFrame, q: DataFrame, few: bool, distance: int = 1) -> DataFrame:
    """Distinct (query_id, q, alias) within an edit distance; of any number of queries, one of ``MOST_DISTANCE`` at most."""
    if few:
        return near(aliases, q.select("query_id", "q").collect(), distance).select("query_id", "q", "alias")
    if distance > MOST_DISTANCE:
        raise InvalidInput(f"a batch is searched up to distance {MOST_DISTANCE}; more distant aliases are for up to {FEW} literal queries")
    a = aliases.withColumn("shape", _shapes("alias", distance))
    b = q.select("query_id", "q").withColumn("shape", _shapes("q", distance))
    return a.join(b, "shape").select("query_id", "q", "alias").distinct().where(F.levenshtein("alias", "q", distance) >= 0)


def prefix(corpus: Corpus, q: DataFrame, asked: list | None = None) -> DataFrame:
    found = prefixed(corpus.aliases, asked) if asked is not None else matched_aliases(corpus, prefix_pairs(corpus.aliases.select("alias").distinct(), q, False))
    return _hit(found, "PrefixAlias", F.col("q"))


def fuzzy(corpus: Corpus, q: DataFrame, asked: list | None = None, distance: int = 1) -> DataFrame:
    found = near(corpus.aliases, asked, distance) if asked is not None else matched_aliases(corpus, fuzzy_pairs(corpus.aliases.select("alias").distinct(), q, False, distance))
    return _hit(found, "FuzzyAlias", F.col("q"))


SIGNALS = {
    "Tag": tag, "Relationship": relationship, "ExactAlias": exact, "PrefixAlias": prefix, "FuzzyAlias": fuzzy, "Token": token,
    "AttributeKeyValue": attribute_pair, "AttributeKey": attribute_key, "AttributeValue": attribute_value, "Source": source,
}


def hits(corpus: Corpus, queries, signals: tuple[str, ...] = tuple(SIGNALS), distance: int = 1) -> DataFrame:
    """Every match: query_id, entity_id, source (the signal), explanation."""
    q, asked = query_frame(corpus, queries)
    more = {"FuzzyAlias": (distance,)}
    return reduce(DataFrame.unionByName, [SIGNALS[s](corpus, q, asked, *more.get(s, ())) for s in signals])


def weigh(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[source]


def score(weight: Column, n: Column) -> Column:
    """In hundredths, so that sums are exact: the largest weight and a bonus for each further signal, 1 at most."""
    return F.least(F.lit(100), F.max(weight) + BONUS * (n - 1)) / F.lit(100.0)


def rank(found: DataFrame, explain: bool = True) -> DataFrame:
    """Hits by entity: query_id, entity_id, score, sources, explanations. Partial aggregates go through one shuffle."""
    explanations = [F.array_sort(F.collect_set("explanation")).alias("explanations")] if explain else []
    return found.withColumn("weight", weigh(F.col("source"))).groupBy("query_id", "entity_id").agg(
        score(F.col("weight"), F.size(F.collect_set("source"))).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), *explanations
    )


def top(ranked: DataFrame, limit: int | None) -> DataFrame:
    """Adds ``rank`` within each query: higher scores first, ties by entity_id. A limit prunes before the shuffle."""
    r = ranked.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")))
    return r if limit is None else r.where(F.col("rank") <= limit)


def search(corpus: Corpus, queries, limit: int | None = None, signals: tuple[str, ...] = tuple(SIGNALS), distance: int = 1, explain: bool = True) -> DataFrame:
    """query_id, rank, entity_id, name, score, sources, explanations."""
    best = top(rank(hits(corpus, queries, signals, distance), explain), limit)
    out = best.join(corpus.names.withColumnRenamed("entity_id", "of"), F.col("entity_id") == F.col("of"))
    return out.select("query_id", "rank", "entity_id", "name", "score", "sources", *(["explanations"] if explain else []))
