"""Text rules that every operator shares, as column expressions, and their driver-side twins for literals."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode White_Space, spelled out for Python's re (its \\s also takes U+001C to U+001F).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


_ENDS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Lower case, hyphens as spaces, no white space at either end. White space inside stays as it is."""
    return F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("-"), F.lit(" ")), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def tokens(normalized: Column | str) -> Column:
    """Words of a normalized text."""
    return F.filter(F.split(_col(normalized), r"\p{IsWhite_Space}+"), lambda t: t != "")


def normalize_text(s: str) -> str:
    return s.lower().replace("-", " ").strip(_ENDS)


def split_tokens(normalized: str) -> list[str]:
    return [t for t in re.split(f"[{WHITE}]+", normalized) if t]


@dataclass(frozen=True)
class Value:
    """A typed value: kind is one of string, integer, float, boolean."""

    kind: str
    value: str | int | float | bool


def parse_value(text: str) -> Value:
    """A literal of the filter language. Normalized first, so a leading minus is a space and is lost."""
    n = normalize_text(text)
    if re.fullmatch(r"[+-]?[0-9]+", n) and -(2**63) <= int(n) < 2**63:
        return Value("integer", int(n))
    if n in ("true", "false"):
        return Value("boolean", n == "true")
    return Value("string", n)


def parse_like(text: str, kind: str) -> Value | None:
    """A text as a value of a given kind, or None."""
    try:
        if kind == "boolean":
            return Value(kind, {"true": True, "false": False}[text])
        return Value(kind, {"string": str, "integer": int, "float": float}[kind](text))
    except (ValueError, KeyError):
        return None


def show_double(d: Column | str) -> Column:
    """A double in the fewest digits that give it back, without an exponent or a trailing ``.0``."""
    d = _col(d)
    s = F.abs(d).cast("string")
    whole, part, power = F.regexp_extract(s, r"^(\d+)\.", 1), F.regexp_extract(s, r"\.(\d+)", 1), F.regexp_extract(s, r"E(-?\d+)$", 1)
    part = F.when(part == "0", "").otherwise(part)
    e = F.when(power == "", F.lit("0")).otherwise(power).cast("int")
    digits = F.concat(whole, part)
    large = F.when(F.length(part) <= e, F.concat(digits, F.repeat(F.lit("0"), e - F.length(part)))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
    plain = F.when(power == "", F.when(part == "", whole).otherwise(s)).when(e > 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    sign = F.when((d < 0) | (d.cast("string").startswith("-")), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, plain))


def value_text(kind: Column, s: Column, i: Column, d: Column, b: Column) -> Column:
    """The normalized text of a typed value."""
    return F.when(kind == "integer", i.cast("string")).when(kind == "float", show_double(d)).when(kind == "boolean", b.cast("string")).otherwise(normalize(s))


def format_bytes(n: int) -> str:
    """A size for people: whole bytes, else one decimal of the largest fitting 1024-based unit, terabytes at most."""
    power = min(max(n.bit_length() - 1, 0) // 10, 4)
    return f"{n / 1024**power:.1f} {'KMGT'[power - 1]}B" if power else f"{n} B"


def timestamp_now() -> int:
    """This moment as dates are kept: milliseconds since 1970 in UTC."""
    return time.time_ns() // 1_000_000


def as_datetime(timestamp: int) -> datetime:
    """A kept date as a moment in UTC."""
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=timestamp)
