import pytest
from helpers import SHOP, write
from loomstone.corpus import Corpus
from loomstone.functions.text import Value
from loomstone.operators import lookups
from loomstone.operators.search import fuzzy_pairs, prefix_pairs, search
from loomstone.sources.readers import read_entities


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    return Corpus(read_entities(spark, write(tmp_path_factory.mktemp("shop") / "e.json", SHOP)).cache())


def found(df):
    return {r["entity_id"]: (round(r["score"], 2), r["sources"]) for r in df.collect()}


CASES = {
    "COLA": {
        1: (1.0, ["ExactAlias", "FuzzyAlias", "PrefixAlias", "Relationship", "Token"]), 11: (1.0, ["ExactAlias", "FuzzyAlias", "PrefixAlias", "Token"]), 20: (1.0, ["ExactAlias", "FuzzyAlias", "PrefixAlias", "Token"]),
        2: (0.78, ["PrefixAlias", "Token"]), 4: (0.78, ["FuzzyAlias", "PrefixAlias"]), 3: (0.7, ["Relationship"]),
    },
    "sugar-free": {1: (0.25, ["Tag"])}, "volume": {1: (0.2, ["AttributeKey"]), 2: (0.2, ["AttributeKey"])}, "at": {3: (0.5, ["AttributeValue"])}, "none at all": {3: (0.5, ["AttributeValue"])},
    "volume>=330ml": {1: (0.85, ["AttributeKeyValue"])}, "open facts": {1: (0.45, ["Source"]), 2: (0.45, ["Source"])}, "drnk": {20: (0.6, ["FuzzyAlias"])}, "nothing here": {},
}


def test_each_query(shop):
    for q, want in CASES.items():
        assert found(search(shop, q)) == want, q
    assert {e: s for e, (s, _) in found(search(shop, "")).items()} == dict.fromkeys([1, 2, 3, 4, 10, 11, 20], 0.75)


def test_batch_forms_agree(spark, shop):
    texts = [*CASES, "", "col", "Aurora Food", "x"]
    few = search(shop, texts)
    frame = search(shop, spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(few) == key(frame)


def test_pairs_agree_on_odd_texts(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "aXc", "naïve", "naive", "日本", "日本語", "本日", "aab", "aba"]
    a = spark.createDataFrame([(w,) for w in words], "alias string")
    q = spark.createDataFrame(list(enumerate(words)), "query_id bigint, q string")
    for pairs in (prefix_pairs, fuzzy_pairs):
        assert sorted(map(tuple, pairs(a, q, True).collect())) == sorted(map(tuple, pairs(a, q, False).collect()))


def test_order_limit_and_explanations(shop):
    rows = search(shop, "cola", limit=4).orderBy("rank").collect()
    assert [(r["rank"], r["entity_id"]) for r in rows] == [(1, 1), (2, 11), (3, 20), (4, 2)]
    assert rows[0]["name"] == "Fizz Cola"
    r = search(shop, "brook").where("entity_id = 3").first()
    assert [(e["kind"], e["term"], e["target"]) for e in r["explanations"]] == [("Relationship", "madeby", 11)]
    r = search(shop, "brand = ACME").first()
    assert [(e["key"], e["value"]) for e in r["explanations"]] == [("brand", "acme")]


def test_stats_and_registry(shop):
    aliases = [a.lower().strip() for e in SHOP for a in e["aliases"]]
    n, words = len(set(aliases)), len({w for a in aliases for w in a.split()})
    want = {"entities": 7, "tags": 5, "sources": 1, "attributes": 4, "relationship_types": 2, "aliases": n, "trie": n, "fuzzy_aliases": len(aliases), "tokens": words, "relationships": 4}
    assert shop.stats().first().asDict() == want
    assert [r["name"] for r in shop.registry("tags").orderBy("id").collect()] == ["soft drink", "sugar free", "water", "company", "category"]


def test_lookups(shop):
    ids = lambda df: sorted(r["entity_id"] for r in df.collect())
    assert [r[0] for r in lookups.resolve(shop, "Cola").collect()] == [1, 11, 20]
    assert ids(lookups.by_prefix(shop, "aur")) == [10] and ids(lookups.by_distance(shop, "kolas", 2)) == [1, 4, 11, 20]
    assert ids(lookups.by_token(shop, "light")) == [2] and ids(lookups.with_tag(shop, "Soft-Drink")) == [1, 2] and ids(lookups.with_source(shop, "Open-Facts")) == [1, 2]
    assert ids(lookups.with_attribute(shop, "Brand", "ACME")) == [1] and ids(lookups.related_to(shop, 10)) == [1, 2]
    assert ids(lookups.with_relationship(shop, "madeby", 10)) == [1, 2] and ids(lookups.with_relationship(shop, "MadeBy", 10)) == []
    assert ids(lookups.relationships_of(shop, 1)) == [1, 1] and ids(lookups.relationships_of(shop, 1, "InstanceOf")) == [1]
    assert ids(lookups.attribute_differs(shop, "volume", Value("string", "330ml"))) == [2]


def test_indexed(shop, tmp_path):
    again = shop.indexed(str(tmp_path / "index"))
    assert found(search(again, "cola")) == found(search(shop, "cola"))
    plan = again.aliases.where("alias = 'cola'")._jdf.queryExecution().toString()
    assert "EqualTo(alias,cola)" in plan
