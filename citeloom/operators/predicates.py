"""Filter languages compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def keywords(c: Column, words: list[str]) -> Column:
    """Any word is contained, whatever the case; null never matches."""
    return F.coalesce(_any([F.contains(F.lower(c), F.lit(w.lower())) for w in words]), F.lit(False))


@dataclass(frozen=True)
class Expression:
    """A keyword expression: AND and OR have one precedence and bind to the left; what follows the
    first term that no operator joins is ignored. strict=True knows phrases and whole-word operators."""

    text: str
    strict: bool = False

    def validate(self) -> None:
        depth = 0
        for ch in self.text:
            depth += (ch == "(") - (ch == ")")
            if depth < 0:
                break
        if not self.text.strip() or depth:
            raise ValueError("an expression needs text and balanced parentheses")

    def tokens(self) -> list[str]:
        if self.strict:
            return re.findall(r'\(|\)|"[^"]*"|[^\s()]+', self.text)
        return re.findall(r"\(|\)|AND|OR|NOT|(?:(?!AND|OR|NOT)[^\s()])+", self.text)

    def compile(self, c: Column) -> Column:
        left = self.tokens()

        def term() -> Column:
            if not left:
                raise ValueError("an expression ends early")
            t = left.pop(0)
            if t == "NOT":
                return ~term()
            if t == "(":
                inner = expression()
                if left and left[0] == ")":
                    left.pop(0)
                return inner
            return F.contains(F.lower(c), F.lit((t.strip('"') if self.strict else t).lower()))

        def expression() -> Column:
            found = term()
            while left and left[0] in ("AND", "OR"):
                op, right = left.pop(0), None
                right = term()
                found = found & right if op == "AND" else found | right
            return found

        # A null value is false even under NOT.
        return F.coalesce(expression(), F.lit(False)) & c.isNotNull()


def any_expression(c: Column, expressions: list[str]) -> Column:
    return _any([Expression(e).compile(c) for e in expressions])


def literal_search(columns: list[Column], q: str) -> Column:
    return _any([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower())) for c in columns])


def year_range(c: Column, low: int | None = None, high: int | None = None, nulls: bool = False) -> Column:
    """Both ends belong to it. nulls: whether a null year passes (staging) or not (catalog)."""
    parts = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    return (c.isNull() | _all(parts)) if nulls else F.coalesce(_all(parts), F.lit(False))


def text_rule(c: Column, op: str, value: str) -> Column:
    t, v = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(value.strip().lower())
    base = {"equals": t == v, "begins_with": F.startswith(t, v), "ends_with": F.endswith(t, v), "contains": F.contains(t, v)}[op.removeprefix("not_")]
    return ~base if op.startswith("not_") else base


def number_rule(c: Column, op: str, value: float, value_to: float | None = None) -> Column:
    x = c.try_cast("double")
    lo, hi = sorted((value, value if value_to is None else value_to))
    rule = {"eq": x == value, "ne": x != value, "lt": x < value, "le": x <= value, "gt": x > value, "ge": x >= value, "between": x.between(lo, hi), "not_between": ~x.between(lo, hi)}[op]
    return F.coalesce(rule, F.lit(False))


def mark_filter(c: Column, allowed: list[str]) -> Column:
    known = {"standard", "good", "neutral", "bad"}
    return F.lit(True) if not allowed or known <= set(allowed) else c.isin(allowed)


def parse_rules(lines: list[str]) -> list[tuple[str, str, str, str | None]]:
    """column::operator::value[::value_to]; what doesn't parse is dropped."""
    found = [tuple(x.strip() for x in line.split("::")) for line in lines]
    return [(*f, None)[:4] for f in found if len(f) in (3, 4) and all(f[:3])]


def rules_of(line: Column) -> Column:
    """As parse_rules of a column with one line: name, rule, value and value_to; null for what doesn't parse."""
    parts = F.transform(F.split(line, "::"), lambda x: F.trim(x))
    whole = F.size(parts).isin(3, 4) & F.forall(F.slice(parts, 1, 3), lambda x: x != "")
    return F.when(whole, F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("name", "rule", "value", "value_to"))]))


def balanced(expression: Column) -> Column:
    """Whether an expression has text and every bracket its partner."""
    steps = F.transform(F.split(expression, ""), lambda ch: F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0))
    walk = F.aggregate(steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda s, x: F.struct((s["depth"] + x).alias("depth"), F.least(s["least"], s["depth"] + x).alias("least")))
    return F.coalesce((F.trim(expression) != "") & (walk["depth"] == 0) & (walk["least"] == 0), F.lit(False))


def paper_id_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^W[0-9]+$") | c.rlike("^[0-9a-fA-F]{24,40}$") | c.rlike("^10\\.[0-9]{4,9}/\\S+$"), F.lit(False))


def venue_allowed(c: Column, ignored: list[str]) -> Column:
    return F.coalesce((c != "") & ~c.isin(ignored), F.lit(False)) if ignored else F.lit(True)


def meaningful_venue(c: Column) -> Column:
    # Fixed values.
    empty = ["na", "tba", "n/a", "undefined", "empty", "not provided", "placeholder", "unspecified", "tbd", "unknown", "not found", "not applicable", "invalid", "unavailable", "missing", "none", "empty string", "default", "no value", "no data", "no information", "not specified", "no entry", "not recorded", "not given", "not supplied", "not defined", "www", ""]
    return F.coalesce(~F.lower(F.trim(c)).isin(empty), F.lit(False))
