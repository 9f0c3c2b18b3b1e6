"""The registered queries of the entity engine over the star-schema tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from loomstone.corpus import Corpus
from loomstone.functions.text import Value
from loomstone.operators import filters, lifecycle, lookups
from loomstone.operators.search import SIGNALS, search
from loomstone.plans.query import Query, parse_filter_expr
from loomstone.schema import WEIGHTS
from loomstone.sources import testdata
from loomstone.sources.scratch import numbered, scratch_dir
from loomstone.sources.store import EntityStore, build, merge_stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (query, signal): searches by one signal only.
SINGLE = {
    "a_exact": ("Red-Bolt", "ExactAlias"),
    "a_prefix": ("red", "PrefixAlias"),
    "a_fuzzy": ("rad bolt", "FuzzyAlias"),
    "a_token": ("ring", "Token"),
    "a_tag": ("PROMO", "Tag"),
    "a_source": ("src0", "Source"),
    "a_attr_key": ("retailprice", "AttributeKey"),
    "a_attr_value": ("Brand#2", "AttributeValue"),
    "a_attr_pair": ("brand=Brand#2", "AttributeKeyValue"),
    "a_attr_pair_op_ignored": ("size>=10", "AttributeKeyValue"),
    "a_relationship": ("NATION_0", "Relationship"),
}
MANY = ["red bolt", "ring", "NATION_1", "brand=Brand#2"]
FILTERS = {
    "b_attr_eq": "brand=Brand#2",
    "b_attr_ne": "brand!=Brand#2",
    "b_attr_lt": "size<10",
    "b_attr_le": "size<=10",
    "b_attr_gt": "size>40",
    "b_attr_ge": "size>=40",
    "b_and": "brand=Brand#2 & size>=10",
    "b_or": "brand=Brand#2 | size>=45",
    "b_mixed": "brand=Brand#2 & size>=10 | brand=Brand#3",
    "b_paren": "brand=Brand#2 & (size>=40 | size<=5)",
    "b_relationship": "relation:located_in:nation_0",
    "b_rel_or_attr": "relation:located_in:nation_0 | brand=Brand#2",
    "b_not": "!brand=Brand#2",
}
STAGES = {"b_exact": ("red bolt", "ExactAlias"), "b_prefix": ("red bolt", "PrefixAlias"), "b_fuzzy": ("nation_1 bolts", "FuzzyAlias"), "b_token": ("red bolt ring", "Token"), "b_tag": ("similar promo", "Tag")}


def corpus(spark: SparkSession, sf_dir: str, *only: str) -> Corpus:
    return Corpus(testdata.entities(spark, sf_dir, only or None), testdata.entities(spark, sf_dir, only or None, makers=False))


def flat(found: DataFrame) -> DataFrame:
    """Arrays as text."""
    return found.select("query_id", "rank", "entity_id", "name", "score", F.array_join("sources", ",").alias("sources"))


def explained(found: DataFrame) -> DataFrame:
    e = found.select("query_id", "entity_id", F.explode("explanations").alias("e"))
    return e.select("query_id", "entity_id", "e.kind", F.coalesce("e.term", F.lit("")).alias("term"), F.coalesce("e.key", F.lit("")).alias("key"), F.coalesce("e.value", F.lit("")).alias("value"), F.coalesce("e.target", F.lit(-1)).alias("target"))


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part names, and each with its first character mistyped; the query is its own id."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("query")).distinct()
    return names.unionByName(names.select(F.concat(F.lit("z"), F.substr("query", F.lit(2))).alias("query"))).distinct().select(F.col("query").alias("query_id"), "query")


def counted(candidates: DataFrame) -> DataFrame:
    return candidates.select("entity_id", F.size("signals").cast("bigint").alias("n_signals"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: signup inserts, error removes, all else updates the user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "remove").otherwise("update")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("entity_id"), F.array(F.concat(F.lit("user "), F.col("event_id").cast("string"))).alias("aliases"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.entities(spark, sf_dir, ("part",))


def _renamed(e: DataFrame) -> DataFrame:
    return e.withColumn("aliases", F.array(F.concat(F.lit("new "), F.col("aliases")[0])))


def _named(e: DataFrame) -> DataFrame:
    return e.select("entity_id", F.col("aliases")[0].alias("name"))


def _digit(e: DataFrame, low: int, high: int) -> DataFrame:
    return e.where((F.col("entity_id") % 10).between(low, high))


def m_insert(spark, d):
    e = _parts(spark, d)
    return _named(lifecycle.insert(_digit(e, 0, 5), _digit(e, 6, 7)))


def m_insert_whole(spark, d):
    """All parts: some as the store, all others as the batch."""
    e = _parts(spark, d)
    return _named(lifecycle.insert(_digit(e, 0, 5), _digit(e, 6, 9)))


def m_update(spark, d):
    e = _parts(spark, d)
    return _named(lifecycle.update(e, _renamed(_digit(e, 2, 3))))


def m_remove(spark, d):
    e = _parts(spark, d)
    return lifecycle.remove(e, _digit(e, 0, 2)).select("entity_id")


def m_validate(spark, d):
    return lifecycle.judged(operations(spark, d)).select("seq", "op", "entity_id", F.coalesce("error", F.lit("")).alias("error"))


def m_replay(spark, d):
    log = operations(spark, d)
    valid = lifecycle.judged(log).where("error is null").drop("error")
    nobody = testdata.entities(spark, d, ("region",)).limit(0)
    return _named(lifecycle.replay(nobody, valid))


def _sides(spark, d):
    e = _parts(spark, d)
    return _digit(e, 0, 5), _renamed(_digit(e, 4, 9))


def _stored(spark, d, last: int):
    """A store built from parts; some updated and some removed, flushed, changed again (parts of digits 8 to last come in),
    compacted, and opened anew."""
    e = _parts(spark, d)
    parent = scratch_dir(spark, "store")
    store = build(spark, _digit(e, 0, 7), parent, "parts")
    store.update(_renamed(_digit(e, 2, 3)))
    store.remove(_digit(e, 0, 0).select("entity_id"))
    store.flush()
    store.insert(_digit(e, 8, last))
    store.compact()
    store.remove(_digit(e, 7, 7).select("entity_id"))
    return _named(EntityStore.open(spark, store.root).entities())


def m_store(spark, d):
    return _stored(spark, d, 8)


def m_store_whole(spark, d):
    """m_store over all parts."""
    return _stored(spark, d, 9)


def m_order(spark, d):
    """The places of all parts in a store that two merged: the left one took two batches, the later ids first, and was not
    flushed; the right one has the other parts, and some that the left one has too."""
    e = _parts(spark, d)
    parent = scratch_dir(spark, "order")
    left = EntityStore.create(spark, parent, "left")
    left.insert(_digit(e, 5, 6))
    left.insert(_digit(e, 1, 2))
    right = EntityStore.create(spark, parent, "right")
    right.insert(e.where(~(F.col("entity_id") % 10).isin(1, 5)))
    merge_stores(spark, left.root, right.root, f"{parent}/both")
    found = numbered(EntityStore.open(spark, f"{parent}/both").entities().select("entity_id", "ord"), f"{parent}/numbered", "place", "ord")
    return found.select("entity_id", "place")


def _single(query: str, signal: str) -> Callable:
    return lambda spark, d: search(corpus(spark, d), query, signals=(signal,), explain=False).select("entity_id", "name", "score")


def _filter(text: str) -> Callable:
    return lambda spark, d: counted(filters.filter_search(corpus(spark, d), text))


def _stage(text: str, kind: str) -> Callable:
    return lambda spark, d: filters.stage(corpus(spark, d), Query.parse(text), kind, 1).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_signals"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable] = {name: _single(*x) for name, x in SINGLE.items()}
    q |= {name: _filter(text) for name, text in FILTERS.items()}
    q |= {name: _stage(*x) for name, x in STAGES.items()}
    q |= {
        "a_search": lambda s, d: flat(search(corpus(s, d), MANY, explain=False)),
        "a_explain": lambda s, d: explained(search(corpus(s, d), MANY)),
        "a_topk": lambda s, d: flat(search(corpus(s, d), "red", limit=10, explain=False)),
        "a_batch": lambda s, d: flat(search(corpus(s, d), batch_queries(s, d), explain=False)).drop("name"),
        "b_lookup": lambda s, d: filters.filter_search(corpus(s, d), "red bolt").select("entity_id", F.array_join("signals", ",").alias("signals")),
        "b_attr_ne_all": lambda s, d: lookups.attribute_differs(corpus(s, d), "size", Value("integer", 10)),
        "b_intersection": lambda s, d: counted(filters.intersection(filters.evaluate(corpus(s, d), parse_filter_expr("brand=Brand#2")), filters.evaluate(corpus(s, d), parse_filter_expr("size>=10")))),
        "b_not_strict": lambda s, d: filters.filter_search(corpus(s, d, "part"), "!brand=Brand#2", strict_not=True).select("entity_id"),
        "b_not_strict_whole": lambda s, d: filters.filter_search(corpus(s, d), "!brand=Brand#2", strict_not=True).select("entity_id"),
        "l_prefix": lambda s, d: lookups.by_prefix(corpus(s, d), "blue"),
        "l_distance": lambda s, d: lookups.by_distance(corpus(s, d), "rad bolts", 2),
        "l_related": lambda s, d: lookups.related_to(corpus(s, d), 1003).select("entity_id", "kind"),
        "l_resolve": lambda s, d: lookups.resolve(corpus(s, d), "Red-Bolt"),
        "l_token": lambda s, d: lookups.by_token(corpus(s, d), "Ring"),
        "l_tag": lambda s, d: lookups.with_tag(corpus(s, d), "PROMO"),
        "l_source": lambda s, d: lookups.with_source(corpus(s, d), "src0"),
        "l_attribute": lambda s, d: lookups.with_attribute(corpus(s, d), "Brand", "Brand#2"),
        "l_compare": lambda s, d: lookups.compare_attribute(corpus(s, d), "acctbal", "<", Value("integer", 0)),
        "l_rel_kind": lambda s, d: lookups.relationships_of(corpus(s, d), 1003, "part_of").select("entity_id", "kind", "target_id"),
        "l_rel_for": lambda s, d: lookups.relationships_of(corpus(s, d), 10_000_001).select("entity_id", "kind", "target_id"),
        "l_relationship": lambda s, d: lookups.with_relationship(corpus(s, d), "located_in", 1003),
        "l_entity": lambda s, d: _named(corpus(s, d).entity(1003)),
        "b_similar": lambda s, d: filters.filter_search(corpus(s, d), "similar promo").select("entity_id", F.array_join("signals", ",").alias("signals")),
        "b_plan_relationship": lambda s, d: filters.filter_search(corpus(s, d), "made ring").select("entity_id", F.array_join("signals", ",").alias("signals")),
        "m_order": m_order,
        "registry_sources": lambda s, d: corpus(s, d).registry("sources"),
        "registry_kinds": lambda s, d: corpus(s, d).registry("relationship_types"),
        "stats": lambda s, d: corpus(s, d).stats(),
        "registry_tags": lambda s, d: corpus(s, d).registry("tags"),
        "registry_keys": lambda s, d: corpus(s, d).registry("attribute_keys"),
        "m_insert": m_insert, "m_update": m_update, "m_remove": m_remove, "m_validate": m_validate, "m_replay": m_replay, "m_store": m_store,
        "m_insert_whole": m_insert_whole, "m_store_whole": m_store_whole,
        "m_merge": lambda s, d: _named(lifecycle.merge(*_sides(s, d))),
        "m_merge_report": lambda s, d: lifecycle.merge_report(*_sides(s, d)),
    }
    return q


CORPUS_SQL = """
ent AS (
  SELECT CAST(r_regionkey AS BIGINT) AS entity_id, [r_name] AS aliases, ['region'] AS tags, 'tpch' AS provider FROM region
  UNION ALL SELECT 1000 + n_nationkey, [n_name], ['nation'], 'tpch' FROM nation
  UNION ALL SELECT 10000000 + s_suppkey, [s_name], ['supplier'], 'tpch' FROM supplier
  UNION ALL SELECT 20000000 + c_custkey, [c_name], ['customer', c_mktsegment], 'tpch' FROM customer
  UNION ALL SELECT 30000000 + p_partkey, [p_name, p_brand || ' ' || p_name], ['part', p_type], 'tpch' FROM part
  UNION ALL SELECT 40000000 + doc_id, ['doc-' || doc_id], ['document', lang], source FROM documents),
names AS (SELECT entity_id, aliases[1] AS name FROM ent),
al AS (SELECT entity_id, trim(replace(lower(alias), '-', ' ')) AS alias FROM (SELECT entity_id, unnest(aliases) AS alias FROM ent)),
tok AS (SELECT entity_id, token FROM (SELECT entity_id, unnest(string_split(alias, ' ')) AS token FROM al) WHERE token <> ''),
tg AS (SELECT DISTINCT entity_id, trim(replace(lower(tag), '-', ' ')) AS tag FROM (SELECT entity_id, unnest(tags) AS tag FROM ent)),
src AS (SELECT entity_id, trim(replace(lower(provider), '-', ' ')) AS source FROM ent),
attr AS (
  SELECT 10000000 + s_suppkey AS entity_id, 'acctbal' AS key, 'float' AS vtype, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS BIGINT) AS i, s_acctbal AS d FROM supplier
  UNION ALL SELECT 20000000 + c_custkey, 'acctbal', 'float', NULL, NULL, c_acctbal FROM customer
  UNION ALL SELECT 30000000 + p_partkey, 'brand', 'string', p_brand, NULL, NULL FROM part
  UNION ALL SELECT 30000000 + p_partkey, 'size', 'integer', NULL, p_size, NULL FROM part
  UNION ALL SELECT 30000000 + p_partkey, 'retailprice', 'float', NULL, NULL, p_retailprice FROM part
  UNION ALL SELECT 40000000 + doc_id, 'n_chars', 'integer', NULL, n_chars, NULL FROM documents),
av AS (SELECT *, CASE vtype WHEN 'string' THEN trim(replace(lower(s), '-', ' ')) WHEN 'integer' THEN CAST(i AS VARCHAR) ELSE regexp_replace(CAST(d AS VARCHAR), '\\.0$', '') END AS v FROM attr),
terms AS (SELECT DISTINCT entity_id, term FROM (SELECT entity_id, v AS term FROM av UNION ALL SELECT entity_id, unnest(string_split(v, ' ')) FROM av) WHERE term <> ''),
rel AS (
  SELECT 1000 + n_nationkey AS entity_id, 'part_of' AS kind, CAST(n_regionkey AS BIGINT) AS target FROM nation
  UNION ALL SELECT 10000000 + s_suppkey, 'located_in', 1000 + s_nationkey FROM supplier
  UNION ALL SELECT 20000000 + c_custkey, 'located_in', 1000 + c_nationkey FROM customer
  UNION ALL SELECT 30000000 + p_partkey, 'made_by', 10000000 + min(l_suppkey) FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)"""


def signals_sql(asked: str) -> str:
    """CTEs q and sig; asked: a query with query_id, q, key and value (normalized)."""
    w = WEIGHTS
    return f"""q AS ({asked}),
sig AS (
  SELECT query_id, entity_id, 'ExactAlias' AS source, {w["ExactAlias"]} AS w, q AS term, NULL AS key, NULL AS value, CAST(NULL AS BIGINT) AS target FROM al JOIN q ON alias = q
  UNION ALL SELECT query_id, entity_id, 'PrefixAlias', {w["PrefixAlias"]}, q, NULL, NULL, NULL FROM al JOIN q ON starts_with(alias, q)
  UNION ALL SELECT query_id, entity_id, 'FuzzyAlias', {w["FuzzyAlias"]}, q, NULL, NULL, NULL FROM al JOIN q ON abs(length(alias) - length(q)) <= 1 AND levenshtein(alias, q) <= 1
  UNION ALL SELECT query_id, entity_id, 'Token', {w["Token"]}, q, NULL, NULL, NULL FROM tok JOIN q ON token = q
  UNION ALL SELECT query_id, entity_id, 'Tag', {w["Tag"]}, q, NULL, NULL, NULL FROM tg JOIN q ON tag = q
  UNION ALL SELECT query_id, entity_id, 'Source', {w["Source"]}, q, NULL, NULL, NULL FROM src JOIN q ON source = q
  UNION ALL SELECT query_id, entity_id, 'AttributeKeyValue', {w["AttributeKeyValue"]}, NULL, q.key, q.value, NULL FROM av JOIN q ON av.key || ':' || av.v = q.key || ':' || q.value
  UNION ALL SELECT query_id, entity_id, 'AttributeKey', {w["AttributeKey"]}, q, NULL, NULL, NULL FROM av JOIN q ON av.key = q AND q.key IS NULL
  UNION ALL SELECT query_id, entity_id, 'AttributeValue', {w["AttributeValue"]}, q, NULL, NULL, NULL FROM terms JOIN q ON terms.term = q AND q.key IS NULL
  UNION ALL SELECT q.query_id, rel.entity_id, 'Relationship', {w["Relationship"]}, rel.kind, NULL, NULL, rel.target FROM q JOIN al ON alias = q JOIN rel ON rel.target = al.entity_id),
ranked AS (SELECT query_id, entity_id, least(100, max(w) + 3 * (count(DISTINCT source) - 1)) / CAST(100.0 AS DOUBLE) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sig GROUP BY ALL),
found AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS INTEGER) AS rank, entity_id, name, score, sources FROM ranked JOIN names USING (entity_id))"""


def asked_sql(texts: list[str]) -> str:
    from loomstone.functions.text import normalize_text
    from loomstone.plans.query import parse_attribute_query

    lit = lambda x: "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"
    rows = []
    for i, t in enumerate(texts):
        pair = parse_attribute_query(t)
        rows.append(f"SELECT CAST({i} AS BIGINT) AS query_id, {lit(normalize_text(t))} AS q, {lit(pair and normalize_text(pair[0]))} AS key, {lit(pair and normalize_text(pair[2]))} AS value")
    return " UNION ALL ".join(rows)


def leaf_sql(leaf) -> str:
    """Rows of entity_id, one per signal."""
    from loomstone.plans.query import RelationshipFilter

    if isinstance(leaf, RelationshipFilter):
        return f"SELECT entity_id FROM rel WHERE kind = '{leaf.kind}' AND target = (SELECT min(entity_id) FROM al WHERE alias = '{leaf.target.lower()}')"
    v, op = leaf.value, leaf.op.replace("!=", "<>")
    if v.kind == "string":
        test = f"NOT (vtype = 'string' AND v = '{v.value}')" if op == "<>" else f"vtype = 'string' AND v {op} '{v.value}'"
    else:
        test = f"coalesce(CAST(i AS DOUBLE), d) {op} {v.value} AND vtype IN ('integer', 'float')"
    return f"SELECT DISTINCT entity_id FROM av WHERE key = '{leaf.key.lower()}' AND {test}"


def expression_sql(e) -> str:
    from loomstone.plans.query import And, Not, Or

    if isinstance(e, And):
        return f"SELECT entity_id FROM ({expression_sql(e.left)}) WHERE entity_id IN ({expression_sql(e.right)})"
    if isinstance(e, Or):
        return f"SELECT entity_id FROM ({expression_sql(e.left)}) UNION ALL SELECT entity_id FROM ({expression_sql(e.right)})"
    if isinstance(e, Not):
        return "SELECT entity_id FROM ent WHERE false"
    return leaf_sql(e)


def stage_sql(text: str, kind: str) -> str:
    words = ", ".join(f"('{t}')" for t in Query.parse(text).tokens)
    w = f"(VALUES {words}) AS w(t)"
    return {
        "ExactAlias": f"SELECT DISTINCT entity_id FROM al WHERE alias = '{text}'",
        "PrefixAlias": f"SELECT entity_id FROM al JOIN {w} ON starts_with(alias, t)",
        "FuzzyAlias": f"SELECT entity_id FROM al JOIN {w} ON levenshtein(alias, t) <= 1",
        "Token": f"SELECT entity_id FROM tok JOIN {w} ON token = t",
        "Tag": f"SELECT entity_id FROM tg JOIN {w} ON tag = t",
    }[kind]


PARTS_SQL = "p AS (SELECT 30000000 + p_partkey AS entity_id, p_name AS name, (30000000 + p_partkey) % 10 AS g FROM part)"
OPERATIONS_SQL = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'remove' ELSE 'update' END AS op, user_id AS entity_id FROM events),
judged AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'update' THEN op END IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'insert', false) AS there FROM ops),
checked AS (SELECT seq, op, entity_id, CASE WHEN op = 'insert' AND there THEN 'EntityAlreadyExists' WHEN op <> 'insert' AND NOT there THEN 'EntityNotFound' ELSE '' END AS error FROM judged)"""


def oracle_sql() -> dict[str, str]:
    c = f"WITH {CORPUS_SQL}"
    o = {name: f"{c}, {signals_sql(asked_sql([text]))}, one AS (SELECT DISTINCT entity_id, w FROM sig WHERE source = '{s}') SELECT entity_id, name, w / CAST(100.0 AS DOUBLE) AS score FROM one JOIN names USING (entity_id)" for name, (text, s) in SINGLE.items()}
    o |= {name: f"{c} SELECT entity_id, count(*) AS n_signals FROM ({expression_sql(parse_filter_expr(text))}) GROUP BY entity_id" for name, text in FILTERS.items()}
    o |= {name: f"{c} SELECT entity_id, count(*) AS n_signals FROM ({stage_sql(*x)}) GROUP BY entity_id" for name, x in STAGES.items()}
    many = f"{c}, {signals_sql(asked_sql(MANY))}"
    lookup = " UNION ALL ".join(f"SELECT entity_id, '{k}' AS signal FROM ({stage_sql('red bolt', k)})" for k in ("ExactAlias", "PrefixAlias", "FuzzyAlias", "Token"))
    all_names = "SELECT DISTINCT query AS query_id, query AS q, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS value FROM (SELECT p_name AS query FROM part UNION ALL SELECT 'z' || substr(p_name, 2) FROM part)"
    parts_only = CORPUS_SQL.replace("\n  UNION ALL SELECT 10000000 + s_suppkey, [s_name], ['supplier'], 'tpch' FROM supplier", "").replace("\n  UNION ALL SELECT 20000000 + c_custkey, [c_name], ['customer', c_mktsegment], 'tpch' FROM customer", "")
    for arm in ("  SELECT CAST(r_regionkey AS BIGINT) AS entity_id, [r_name] AS aliases, ['region'] AS tags, 'tpch' AS provider FROM region\n  UNION ALL SELECT 1000 + n_nationkey, [n_name], ['nation'], 'tpch' FROM nation",):
        parts_only = parts_only.replace(arm, "  SELECT CAST(1000 + n_nationkey AS BIGINT) AS entity_id, [n_name] AS aliases, ['nation'] AS tags, 'tpch' AS provider FROM nation")
    parts_only = parts_only.replace("\n  UNION ALL SELECT 40000000 + doc_id, ['doc-' || doc_id], ['document', lang], source FROM documents", "")
    registry = lambda rows: f"{c}, r AS ({rows}) SELECT CAST(row_number() OVER (ORDER BY min(place)) - 1 AS INTEGER) AS id, name FROM r GROUP BY name"
    o |= {
        "a_search": f"{many} SELECT * FROM found",
        "a_explain": f"{many} SELECT DISTINCT query_id, entity_id, source AS kind, coalesce(term, '') AS term, coalesce(key, '') AS key, coalesce(value, '') AS value, coalesce(target, -1) AS target FROM sig",
        "a_topk": f"{c}, {signals_sql(asked_sql(['red']))} SELECT * FROM found WHERE rank <= 10",
        "a_batch": f"WITH {parts_only}, {signals_sql(all_names)} SELECT query_id, rank, entity_id, score, sources FROM found",
        "b_lookup": f"{c} SELECT entity_id, string_agg(signal, ',' ORDER BY signal) AS signals FROM ({lookup}) GROUP BY entity_id",
        "b_attr_ne_all": f"{c} SELECT entity_id FROM av WHERE key = 'size' GROUP BY entity_id HAVING bool_and(i <> 10)",
        "b_intersection": f"{c} SELECT entity_id, CAST(2 AS BIGINT) AS n_signals FROM (SELECT entity_id FROM av WHERE key = 'brand' AND v = 'brand#2' INTERSECT SELECT entity_id FROM av WHERE key = 'size' AND i >= 10)",
        "b_not_strict": "SELECT 30000000 + p_partkey AS entity_id FROM part WHERE p_brand <> 'Brand#2'",
        "b_not_strict_whole": f"{c} SELECT entity_id FROM ent ANTI JOIN (SELECT entity_id FROM av WHERE key = 'brand' AND vtype = 'string' AND v = 'brand#2') USING (entity_id)",
        "l_prefix": f"{c} SELECT DISTINCT entity_id FROM al WHERE starts_with(alias, 'blue')",
        "l_distance": f"{c} SELECT DISTINCT entity_id FROM al WHERE levenshtein(alias, 'rad bolts') <= 2",
        "l_related": f"{c} SELECT entity_id, kind FROM rel WHERE target = 1003",
        "l_resolve": f"{c} SELECT DISTINCT entity_id FROM al WHERE alias = 'red bolt'",
        "l_token": f"{c} SELECT DISTINCT entity_id FROM tok WHERE token = 'ring'",
        "l_tag": f"{c} SELECT entity_id FROM tg WHERE tag = 'promo'",
        "l_source": f"{c} SELECT DISTINCT entity_id FROM src WHERE source = 'src0'",
        "l_attribute": f"{c} SELECT DISTINCT entity_id FROM av WHERE key = 'brand' AND v = 'brand#2'",
        "l_compare": f"{c} SELECT DISTINCT entity_id FROM av WHERE key = 'acctbal' AND d < 0",
        "l_rel_kind": f"{c} SELECT entity_id, kind, target AS target_id FROM rel WHERE entity_id = 1003 AND kind = 'part_of'",
        "l_rel_for": f"{c} SELECT entity_id, kind, target AS target_id FROM rel WHERE entity_id = 10000001",
        "l_relationship": f"{c} SELECT entity_id FROM rel WHERE kind = 'located_in' AND target = 1003",
        "l_entity": f"{c} SELECT entity_id, name FROM names WHERE entity_id = 1003",
        "b_similar": f"{c} SELECT entity_id, string_agg('Tag', ',') AS signals FROM ({stage_sql('similar promo', 'Tag')}) GROUP BY entity_id",
        "b_plan_relationship": f"{c} SELECT entity_id, string_agg('Token', ',') AS signals FROM ({stage_sql('made ring', 'Token')}) GROUP BY entity_id",
        "m_order": f"WITH {PARTS_SQL} SELECT entity_id, row_number() OVER (ORDER BY CASE WHEN g IN (5, 6) THEN 0 WHEN g IN (1, 2) THEN 1 ELSE 2 END, entity_id) - 1 AS place FROM p",
        "registry_sources": registry("SELECT source AS name, {'e': entity_id} AS place FROM src"),
        "registry_kinds": registry("SELECT kind AS name, {'e': entity_id} AS place FROM rel"),
        "stats": f"""{c} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(DISTINCT tag) FROM tg) AS tags, (SELECT count(DISTINCT source) FROM src) AS sources, (SELECT count(DISTINCT key) FROM attr) AS attributes,
          (SELECT count(DISTINCT kind) FROM rel) AS relationship_types, (SELECT count(DISTINCT alias) FROM al) AS aliases, (SELECT count(DISTINCT alias) FROM al) AS trie, (SELECT count(*) FROM al) AS fuzzy_aliases,
          (SELECT count(DISTINCT token) FROM tok) AS tokens, (SELECT count(*) FROM rel) AS relationships""",
        "registry_tags": registry("SELECT lower(tags[k]) AS name, {'e': entity_id, 'k': k} AS place FROM (SELECT entity_id, tags, unnest([1, 2]) AS k FROM ent) WHERE k <= len(tags)"),
        "registry_keys": registry("SELECT key AS name, {'e': entity_id, 'k': CASE key WHEN 'size' THEN 1 WHEN 'retailprice' THEN 2 ELSE 0 END} AS place FROM attr"),
        "m_insert": f"WITH {PARTS_SQL} SELECT entity_id, name FROM p WHERE g <= 7",
        "m_update": f"WITH {PARTS_SQL} SELECT entity_id, CASE WHEN g IN (2, 3) THEN 'new ' || name ELSE name END AS name FROM p",
        "m_remove": f"WITH {PARTS_SQL} SELECT entity_id FROM p WHERE g > 2",
        "m_validate": f"WITH {OPERATIONS_SQL} SELECT * FROM checked",
        "m_replay": f"WITH {OPERATIONS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS k FROM checked WHERE error = '') SELECT entity_id, 'user ' || seq AS name FROM f WHERE k = 1 AND op <> 'remove'",
        "m_store": f"WITH {PARTS_SQL} SELECT entity_id, CASE WHEN g IN (2, 3) THEN 'new ' || name ELSE name END AS name FROM p WHERE g BETWEEN 1 AND 8 AND g <> 7",
        "m_insert_whole": f"WITH {PARTS_SQL} SELECT entity_id, name FROM p",
        "m_store_whole": f"WITH {PARTS_SQL} SELECT entity_id, CASE WHEN g IN (2, 3) THEN 'new ' || name ELSE name END AS name FROM p WHERE g NOT IN (0, 7)",
        "m_merge": f"WITH {PARTS_SQL} SELECT entity_id, CASE WHEN g > 5 THEN 'new ' || name ELSE name END AS name FROM p",
        "m_merge_report": f"WITH {PARTS_SQL} SELECT count(*) AS entities_added, (SELECT count(*) FROM p WHERE g IN (4, 5)) AS entities_skipped FROM p",
    }
    return o


__all__ = ["SIGNALS", "oracle_sql", "queries"]
