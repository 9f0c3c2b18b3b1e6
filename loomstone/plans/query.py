"""Queries: the boolean filter language, intents, and the plan of stages. Driver side, no Spark.

Filter grammar: ``or := and ('|' and)*``, ``and := unary ('&' unary)*``, ``unary := '!' unary | '(' or ')' | leaf``. A leaf runs
to white space or one of ``& | ( )``, and is ``key OP value`` or ``relation:kind:target``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomstone.functions.text import WHITE, Value, normalize_text, parse_value, split_tokens

#: In this order an operator is looked for.
OPERATORS = (">=", "<=", "!=", "=", ">", "<")
LOOKUP, BROWSE, FILTER, RELATIONSHIP, SIMILAR, TAG, UNKNOWN = "Lookup", "Browse", "Filter", "Relationship", "Similar", "Tag", "Unknown"
#: What in a normalized query tells an intent, wherever it stands.
SIMILAR_MARKS = ("similar", "like", "alternative")
RELATIONSHIP_MARKS = ("by", "from", "made")


@dataclass(frozen=True)
class AttributeFilter:
    key: str
    op: str
    value: Value


@dataclass(frozen=True)
class RelationshipFilter:
    kind: str
    target: str


@dataclass(frozen=True)
class TagFilter:
    tag: str


@dataclass(frozen=True)
class SourceFilter:
    source: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


def parse_attribute_query(query: str) -> tuple[str, str, str] | None:
    """key, operator and value, by the first operator in OPERATORS that has text on both sides of its first occurrence."""
    for op in OPERATORS:
        key, found, value = query.partition(op)
        if found and key and value:
            return key, op, value
    return None


def parse_leaf(token: str) -> AttributeFilter | RelationshipFilter | None:
    """Unlike a whole-query attribute, the first operator that occurs decides."""
    if token.startswith("relation:"):
        kind, colon, target = token[len("relation:") :].partition(":")
        return RelationshipFilter(kind, target) if colon else None
    op = next((op for op in OPERATORS if op in token), None)
    if op is None:
        return None
    key, _, value = token.partition(op)
    return AttributeFilter(key, op, parse_value(value)) if key and value else None


def parse_filters(query: str) -> list:
    """Every white-space separated token that is a leaf."""
    return [leaf for token in re.split(f"[{WHITE}]+", query) if (leaf := parse_leaf(token))]


_LEXEME = re.compile(rf"[{WHITE}]*(?:([&|()])|([^{WHITE}&|()]+))")


def _lexemes(text: str) -> list[str]:
    """Marks and words. A word's leading exclamation marks are marks of their own."""
    out: list[str] = []
    for m in _LEXEME.finditer(text):
        if m[1]:
            out.append(m[1])
        else:
            bare = m[2].lstrip("!")
            out += ["!"] * (len(m[2]) - len(bare)) + ([bare] if bare else [])
    return out


def parse_filter_expr(text: str):
    """The expression, or None if the text is not one."""
    todo = _lexemes(text)[::-1]
    peek = lambda: todo[-1] if todo else ""

    class NoFilter(Exception):
        pass

    def chain(mark, kind, part):
        left = part()
        while peek() == mark:
            todo.pop()
            left = kind(left, part())
        return left

    def disjunction():
        return chain("|", Or, lambda: chain("&", And, unary))

    def unary():
        if peek() == "!":
            todo.pop()
            return Not(unary())
        if peek() == "(":
            todo.pop()
            inner = disjunction()
            if not todo or todo.pop() != ")":
                raise NoFilter
            return inner
        leaf = parse_leaf(todo.pop()) if todo and todo[-1] not in "&|)" else None
        if leaf is None:
            raise NoFilter
        return leaf

    try:
        found = disjunction()
    except NoFilter:
        return None
    return None if todo else found


@dataclass
class Query:
    original: str
    normalized: str
    tokens: list[str]
    intent: str
    filter: object = None

    @classmethod
    def parse(cls, text: str) -> Query:
        normalized, expr = normalize_text(text), parse_filter_expr(text)
        if expr is not None:
            intent = FILTER
        else:
            intent = _marked(normalized) or LOOKUP
        return cls(text, normalized, split_tokens(normalized), intent, expr)


def _marked(normalized: str) -> str | None:
    if any(m in normalized for m in SIMILAR_MARKS):
        return SIMILAR
    if any(m in normalized for m in RELATIONSHIP_MARKS):
        return RELATIONSHIP
    return None


def detect_intent(query: Query) -> str:
    """The intent without filters: several words that tell nothing are for browsing."""
    return _marked(query.normalized) or (LOOKUP if len(query.tokens) == 1 else BROWSE)


@dataclass(frozen=True)
class Stage:
    kind: str  # ExactAlias, PrefixAlias, FuzzyAlias, Token, Tag, Attribute, Relationship
    distance: int | None = None


@dataclass
class Plan:
    stages: list[Stage] = field(default_factory=list)

    @classmethod
    def of(cls, query: Query) -> Plan:
        fixed = {
            LOOKUP: [Stage("ExactAlias"), Stage("PrefixAlias"), Stage("FuzzyAlias", 1), Stage("Token")],
            BROWSE: [Stage("Tag"), Stage("Token")],
            RELATIONSHIP: [Stage("Relationship"), Stage("Token")],
            SIMILAR: [Stage("Tag"), Stage("Attribute")],
            TAG: [Stage("Tag")],
            UNKNOWN: [Stage("Token")],
        }
        if query.intent != FILTER:
            return cls(fixed[query.intent])
        kinds = {AttributeFilter: "Attribute", RelationshipFilter: "Relationship", TagFilter: "Tag"}
        return cls(list(dict.fromkeys(Stage(kinds[type(x)]) for x in leaves(query.filter) if type(x) in kinds)))


def leaves(expr) -> list:
    """The leaves of an expression, left to right."""
    if isinstance(expr, (And, Or)):
        return leaves(expr.left) + leaves(expr.right)
    return leaves(expr.inner) if isinstance(expr, Not) else [expr]
