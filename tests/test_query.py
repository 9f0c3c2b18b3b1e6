import pytest
from loomstone.functions.text import Value
from loomstone.plans.query import And, AttributeFilter, Not, Or, Plan, Query, RelationshipFilter, Stage, detect_intent, leaves, parse_attribute_query, parse_filter_expr, parse_filters

A = lambda k, op, v: AttributeFilter(k, op, Value("string" if isinstance(v, str) else "integer", v))


@pytest.mark.parametrize(
    "text, want",
    [("a=1", ("a", "=", "1")), ("a>=1", ("a", ">=", "1")), ("=a>1", ("=a", ">", "1")), ("a=", None), ("=", None), ("plain", None), ("brand = Acme", ("brand ", "=", " Acme")), ("a!=b", ("a", "!=", "b"))],
)
def test_attribute_query(text, want):
    assert parse_attribute_query(text) == want


def test_attribute_query_as_a_column(spark):
    from loomstone.operators.search import attribute_query

    texts = ["a=1", "a>=1", "=a>1", "a=", "=", "plain", "brand = Acme", "a!=b", "x<=y=z", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", attribute_query("t").alias("p")).collect()
    for r in got:
        want = parse_attribute_query(r["t"])
        assert (r["p"] and (r["p"]["key"], r["p"]["value"])) == (want and (want[0], want[2]))


@pytest.mark.parametrize(
    "text, want",
    [
        ("brand=Acme", A("brand", "=", "acme")), ("a=1 & b=2 | c=3", Or(And(A("a", "=", 1), A("b", "=", 2)), A("c", "=", 3))), ("a=1 & (b=2 | c=3)", And(A("a", "=", 1), Or(A("b", "=", 2), A("c", "=", 3)))),
        ("!a=1", Not(A("a", "=", 1))), ("!!a=1", Not(Not(A("a", "=", 1)))), ("!(a=1|b=2)", Not(Or(A("a", "=", 1), A("b", "=", 2)))), ("a!=1", A("a", "!=", 1)),
        ("relation:made_by:Acme", RelationshipFilter("made_by", "Acme")), ("relation:x", None), ("a=1 b=2", None), ("a=1 &", None), ("(a=1", None), ("a=1)", None), ("", None), ("word", None), ("a=", None),
        ("=a>1", None), ("brand=A&B", None), ("| a=1", None), ("a=1!", A("a", "=", "1!")),
    ],
)
def test_filter_expr(text, want):
    assert parse_filter_expr(text) == want


def test_six_operators():
    assert [f.op for f in parse_filters("a=1 b!=2 c<3 d<=4 e>5 f>=6 nothing")] == ["=", "!=", "<", "<=", ">", ">="]


@pytest.mark.parametrize("text, intent", [("red bolt", "Lookup"), ("ruby", "Relationship"), ("likely", "Similar"), ("made for", "Relationship"), ("a=1", "Filter"), ("", "Lookup")])
def test_intent(text, intent):
    assert Query.parse(text).intent == intent


def test_browse_and_plans():
    assert detect_intent(Query.parse("two words")) == "Browse" and detect_intent(Query.parse("one")) == "Lookup"
    assert Plan.of(Query.parse("red bolt")).stages == [Stage("ExactAlias"), Stage("PrefixAlias"), Stage("FuzzyAlias", 1), Stage("Token")]
    assert Plan.of(Query.parse("a=1 & b=2 | relation:x:y")).stages == [Stage("Attribute"), Stage("Relationship")]
    assert len(leaves(parse_filter_expr("a=1 & !(b=2 | c=3)"))) == 3
