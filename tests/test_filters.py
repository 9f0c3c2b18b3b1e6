import pytest
from loomstone.corpus import Corpus
from loomstone.functions.text import Value
from loomstone.operators import filters
from loomstone.plans.query import TagFilter, parse_filter_expr
from loomstone.schema import ENTITY


@pytest.fixture(scope="module")
def typed(spark):
    def a(key, kind, v):
        return {"key": key, "vtype": kind} | {c: v if c == {"string": "s", "integer": "i", "float": "d", "boolean": "b"}[kind] else None for c in "sidb"}

    rows = [
        (1, 1, ["Cheap One"], ["t"], [a("brand", "string", "Acme"), a("price", "integer", 5)], [], []), (2, 2, ["Dear Two"], [], [a("brand", "string", "other"), a("price", "integer", 20)], [], []),
        (3, 3, ["Cheap Three", "Cheap"], [], [a("brand", "string", "other"), a("price", "float", 5.0)], [{"kind": "Maker", "target": 4}], []), (4, 4, ["Maker Four", "Four Maker"], [], [a("price", "float", float("nan")), a("flag", "boolean", True)], [], []),
        (5, 5, ["Maker Four"], [], [], [{"kind": "maker", "target": 4}, {"kind": "maker", "target": 4}, {"kind": "maker", "target": 5}], []),
        (6, 6, [], [], [a("brand", "string", "acme"), a("brand", "string", "other"), a("price", "string", "7")], [], []),
    ]
    return Corpus(spark.createDataFrame(rows, ENTITY).cache())


@pytest.mark.parametrize(
    "text, want",
    [
        ("brand=ACME", [1, 6]), ("brand!=acme", [2, 3, 6]), ("price=5", [1]), ("price<=5", [1, 3]), ("price>=5", [1, 2, 3]), ("price<6", [1, 3]), ("price>5", [2]), ("price>abc", []), ("price!=5", [2, 3, 4, 6]), ("flag=true", [4]), ("flag>false", []),
        ("brand=acme & price>=5", [1]), ("brand=acme | brand=other", [1, 2, 3, 6]), ("brand=acme & price>=10 | brand=other", [2, 3, 6]), ("brand=acme & (price>=10 | price<=5)", [1]), ("missing=1", []), ("!brand=acme", []), ("!brand=acme | price=5", [1]),
        ("relation:maker:maker-four", [3, 5]), ("relation:Maker:maker-four", []), ("relation:maker:nobody", []), ("relation:maker:maker-four & brand=other", [3]),
    ],
)
def test_expressions(typed, text, want):
    assert sorted(r["entity_id"] for r in filters.filter_search(typed, text).collect()) == want


def test_one_pass_equals_composition(typed):
    for text in ("brand=acme | brand=other", "brand=other & price>=5 | price<6", "(brand=acme | brand=other) & (price>0 | price=5)"):
        expr = parse_filter_expr(text)

        def composed(e):
            kind = type(e).__name__
            if kind == "And":
                return filters.intersect(composed(e.left), composed(e.right))
            if kind == "Or":
                return filters.union(composed(e.left), composed(e.right))
            return filters.leaf_candidates(typed, e)

        key = lambda df: sorted((r["entity_id"], tuple(r["signals"])) for r in df.collect())
        assert key(filters.evaluate(typed, expr)) == key(composed(expr))


def test_strict_not_and_extended_leaves(typed):
    assert sorted(r[0] for r in filters.filter_search(typed, "!brand=acme", strict_not=True).collect()) == [2, 3, 4, 5]
    assert filters.leaf_candidates(typed, TagFilter("t")).count() == 0
    assert [r[0] for r in filters.leaf_candidates(typed, TagFilter("t"), extended=True).collect()] == [1]


def test_floats_compare_with_floats(spark, typed):
    ids = lambda op, v: sorted(r[0] for r in filters.attribute_entities(typed, "price", op, Value("float", v)).collect())
    assert ids("=", 5.0) == [3] and ids("<=", 5.0) == [1, 3] and ids(">", 4.5) == [1, 2, 3] and ids("!=", 5.0) == [1, 2, 4, 6] and ids("=", float("nan")) == []


def test_stages_repeat_signals(typed):
    got = filters.filter_search(typed, "cheap four").where("entity_id = 3").first()
    assert got["signals"] == ["FuzzyAlias", "PrefixAlias", "PrefixAlias", "Token", "Token"]
    assert sorted(filters.filter_search(typed, "cheap").where("entity_id = 3").first()["signals"]) == ["ExactAlias", "FuzzyAlias", "PrefixAlias", "PrefixAlias", "Token", "Token"]
    assert filters.filter_search(typed, "").count() == 0


def test_intersection_keeps_both(typed):
    a, b = (filters.evaluate(typed, parse_filter_expr(x)) for x in ("brand=acme", "price>=5"))
    assert [(r[0], r[1]) for r in filters.intersection(a, b).collect()] == [(1, ["Property", "Property"])]
