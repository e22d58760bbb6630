"""Index predicates: a small tree that becomes one boolean column.

An index is an array column of string, long or double values; a missing value is a null or empty
array. A positive condition holds if any value matches, its negation if none does, so that keys
without a value match every negated condition. ``not`` of a number comparison is the opposite
comparison, which needs a value. No condition is ever null.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT, CASE_INSENSITIVE = "strict", "case_insensitive"
STRING, LONG, DOUBLE = "string", "long", "double"
_TEXT = ("contains", "starts_with", "ends_with", "matches_regex")
_ORDER = {"gt": "le", "le": "gt", "lt": "ge", "ge": "lt"}


class PredicateError(ValueError):
    """A predicate that does not fit its index."""


class Condition:
    def __and__(self, other: Condition) -> Condition:
        return And(self, other)

    def __or__(self, other: Condition) -> Condition:
        return Or(self, other)

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True, eq=False)
class And(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True, eq=False)
class Or(Condition):
    left: Condition
    right: Condition


@dataclass(frozen=True, eq=False)
class Not(Condition):
    inner: Condition


@dataclass(frozen=True, eq=False)
class Leaf(Condition):
    index: str
    kind: str
    op: str
    value: object
    mode: str = STRICT
    tolerance: float = 0.0
    negated: bool = False


def normalise(c: Condition, negate: bool = False) -> Condition:
    """The same condition without ``Not``: negations are pushed to the leaves."""
    if isinstance(c, Not):
        return normalise(c.inner, not negate)
    if isinstance(c, And | Or):
        kind = type(c) if not negate else (Or if isinstance(c, And) else And)
        return kind(normalise(c.left, negate), normalise(c.right, negate))
    if not negate:
        return c
    if c.op in _ORDER:
        return replace(c, op=_ORDER[c.op])
    return replace(c, negated=not c.negated)


def indices_of(c: Condition) -> set[tuple[str, str]]:
    if isinstance(c, Leaf):
        return {(c.index, c.kind)}
    return indices_of(c.inner) if isinstance(c, Not) else indices_of(c.left) | indices_of(c.right)


def _test(c: Leaf, v: Column) -> Column:
    value = c.value
    if c.kind == STRING:
        fold = c.mode == CASE_INSENSITIVE
        if c.op == "matches_regex":  # the whole value must match
            return v.rlike(("(?i)" if fold else "") + rf"\A(?:{value})\z")
        v = F.lower(v) if fold else v
        if c.op == "in":
            return v.isin([x.lower() if fold else x for x in value]) if value else F.lit(False)
        value = F.lit(value.lower() if fold else value)
        return {
            "contains": lambda: F.contains(v, value), "starts_with": lambda: F.startswith(v, value),
            "ends_with": lambda: F.endswith(v, value), "eq": lambda: v == value,
        }[c.op]()
    if c.op == "in":
        if c.kind == LONG:
            return v.isin(list(value)) if value else F.lit(False)
        tol = abs(c.tolerance)
        found = F.lit(False)
        for x in value or ():
            found = found | (F.abs(v - F.lit(x)) <= tol)
        return found
    value = F.lit(value)
    if c.op == "eq" and c.kind == DOUBLE:
        return (v - c.tolerance <= value) & (value <= v + c.tolerance)
    return {
        "eq": lambda: v == value, "gt": lambda: v > value, "ge": lambda: v >= value, "lt": lambda: v < value,
        "le": lambda: v <= value,
    }[c.op]()


def to_column(c: Condition, indices: dict[str, tuple[str, Column]]) -> Column:
    """The condition over ``indices``: name to (kind, array column). Wrong kinds and names are errors."""
    for name, kind in sorted(indices_of(c)):
        if name not in indices:
            raise PredicateError(f"no index is named {name!r}")
        if indices[name][0] != kind:
            raise PredicateError(f"index {name!r} holds {indices[name][0]} values, not {kind}")

    def build(c: Condition) -> Column:
        if isinstance(c, And):
            return build(c.left) & build(c.right)
        if isinstance(c, Or):
            return build(c.left) | build(c.right)
        hit = F.coalesce(F.exists(indices[c.index][1], lambda v: _test(c, v)), F.lit(False))
        return ~hit if c.negated else hit

    return build(normalise(c))


class Where:
    """``where("name").contains("x")`` and its like."""

    def __init__(self, index: str):
        self.index = index

    def _leaf(self, kind, op, value, mode=STRICT, tolerance=0.0, negated=False) -> Leaf:
        return Leaf(self.index, kind, op, value, mode, tolerance, negated)

    def _kind(self, value) -> str:
        if isinstance(value, str):
            return STRING
        if isinstance(value, int) and not isinstance(value, bool):
            return LONG
        if isinstance(value, float):
            return DOUBLE
        raise PredicateError(f"values are strings, longs or doubles, not {type(value).__name__}")

    def is_equal_to(self, value, tolerance: float = 0.0):
        if tolerance < 0:
            raise PredicateError("the tolerance must not be negative")
        return self._leaf(self._kind(value), "eq", value, tolerance=tolerance)

    def is_not_equal_to(self, value, tolerance: float = 0.0):
        return replace(self.is_equal_to(value, tolerance), negated=True)

    def is_equal_to_ignore_case(self, value):
        return self._leaf(STRING, "eq", value, CASE_INSENSITIVE)

    def is_not_equal_to_ignore_case(self, value):
        return self._leaf(STRING, "eq", value, CASE_INSENSITIVE, negated=True)

    def is_greater_than(self, value):
        return self._leaf(self._kind(value), "gt", value)

    def is_greater_than_or_equal_to(self, value):
        return self._leaf(self._kind(value), "ge", value)

    def is_less_than(self, value):
        return self._leaf(self._kind(value), "lt", value)

    def is_less_than_or_equal_to(self, value):
        return self._leaf(self._kind(value), "le", value)

    def in_strings(self, values):
        return self._leaf(STRING, "in", sorted(values or ()))

    def in_strings_ignore_case(self, values):
        return self._leaf(STRING, "in", sorted(values or ()), CASE_INSENSITIVE)

    def not_in_strings(self, values):
        return self._leaf(STRING, "in", sorted(values or ()), negated=True)

    def not_in_strings_ignore_case(self, values):
        return self._leaf(STRING, "in", sorted(values or ()), CASE_INSENSITIVE, negated=True)

    def in_longs(self, values):
        return self._leaf(LONG, "in", sorted(values or ()))

    def not_in_longs(self, values):
        return self._leaf(LONG, "in", sorted(values or ()), negated=True)

    def in_doubles(self, values, tolerance: float = 0.0):
        return self._leaf(DOUBLE, "in", sorted(values or ()), tolerance=tolerance)

    def not_in_doubles(self, values, tolerance: float = 0.0):
        return self._leaf(DOUBLE, "in", sorted(values or ()), tolerance=tolerance, negated=True)


def _text_methods(op: str) -> None:
    for mode, ending in ((STRICT, ""), (CASE_INSENSITIVE, "_ignore_case")):
        for negated in (False, True):
            name = ("not_" if negated else "") + op + ending

            def method(self, value, op=op, mode=mode, negated=negated):
                return self._leaf(STRING, op, value, mode, negated=negated)

            setattr(Where, name, method)


for _op in _TEXT:
    _text_methods(_op)


def where(index: str) -> Where:
    return Where(index)
