"""Predicates on graph properties, which may be scalars or collections.

``P.eq(3)`` and its like build a test; ``test(column, is_array)`` gives a boolean column that is
never null. A missing property matches nothing. Of a present one, a negated predicate is the exact
opposite of the plain one. Collections: an empty side never matches; one against one compares; many
properties against one value match if any does; many against many match if each does; one against
many never matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    """One value against one: ``pair``; ``values`` are the right side."""

    pair: Callable[[Column, object], Column]
    values: tuple
    negated: bool = False
    any_of: bool = False

    def __call__(self, v: Column, is_array: bool = False) -> Column:
        if not is_array:
            return self._scalar(v)
        items = F.filter(v, lambda x: x.isNotNull())

        def one(x: Column) -> Column:
            hit = F.lit(False)
            for value in self.values:
                hit = hit | F.coalesce(self.pair(x, value), F.lit(False))
            return hit

        if not self.values:
            hit = F.lit(False)
        elif self.any_of or len(self.values) == 1:
            hit = F.exists(items, one)
        else:  # many on the right: each on the left must match, and one alone never does
            hit = (F.size(items) > 1) & F.forall(items, one)
        hit = F.coalesce(hit, F.lit(False))
        return F.coalesce(F.size(items) > 0, F.lit(False)) & (~hit if self.negated else hit)

    def _scalar(self, v: Column) -> Column:
        """Of plain comparisons only, so that they reach the scan."""
        hits = [self.pair(v, value) for value in self.values] if self.any_of or len(self.values) == 1 else []
        hit = hits[0] if hits else F.lit(False)
        for h in hits[1:]:
            hit = hit | h
        return v.isNotNull() & (~F.coalesce(hit, F.lit(False)) if self.negated else hit)

    def negate(self) -> Test:
        return Test(self.pair, self.values, not self.negated, self.any_of)


@dataclass(frozen=True)
class Both:
    """Two tests joined by and/or."""

    left: object
    right: object
    conj: bool

    def __call__(self, v: Column, is_array: bool = False) -> Column:
        a, b = self.left(v, is_array), self.right(v, is_array)
        return a & b if self.conj else a | b

    def negate(self) -> Both:
        return Both(self.left.negate(), self.right.negate(), not self.conj)


def _num(x: Column, value) -> tuple[Column, Column]:
    """Both sides; whole numbers stay whole, so that those above 2^53 are told apart."""
    if isinstance(value, float):
        return x.cast("double"), F.lit(value)
    return x, F.lit(value)


def _cmp(name: str):
    def pair(x, value):
        a, b = _num(x, value)
        return {"eq": a == b, "gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[name]

    return pair


def _values(value) -> tuple:
    return tuple(value) if isinstance(value, list | tuple | set | frozenset) else (value,)


def _text(test, fold: bool):
    def pair(x, value):
        if fold:
            return test(F.lower(x.cast("string")), value.lower())
        return test(x.cast("string"), value)

    return pair


def _regex(fold: bool):
    return lambda x, value: x.cast("string").rlike(("(?i)" if fold else "") + rf"\A(?:{value})\z")


class P:
    """Predicate builders."""

    @staticmethod
    def eq(value, tolerance: float | None = None):
        if tolerance is not None:  # strictly closer than the tolerance
            return Test(lambda x, v: F.abs(x.cast("double") - F.lit(float(v))) < tolerance, _values(value))
        return Test(_cmp("eq"), _values(value))

    @staticmethod
    def neq(value, tolerance: float | None = None):
        return P.eq(value, tolerance).negate()

    @staticmethod
    def gt(value):
        return Test(_cmp("gt"), _values(value))

    @staticmethod
    def gte(value):
        return Test(_cmp("gte"), _values(value))

    @staticmethod
    def lt(value):
        return Test(_cmp("lt"), _values(value))

    @staticmethod
    def lte(value):
        return Test(_cmp("lte"), _values(value))

    @staticmethod
    def within(*values, tolerance: float | None = None, ignore_case: bool = False):
        flat = tuple(x for v in values for x in _values(v))
        if tolerance is not None:
            return Test(lambda x, v: F.abs(x.cast("double") - F.lit(float(v))) <= abs(tolerance), flat, any_of=True)
        pair = _text(lambda x, v: x == F.lit(v), True) if ignore_case else _cmp("eq")
        return Test(pair, flat, any_of=True)

    @staticmethod
    def without(*values, **kw):
        return P.within(*values, **kw).negate()

    @staticmethod
    def inside(a, b):
        return Both(P.gt(a), P.lt(b), True)

    @staticmethod
    def outside(a, b):
        return Both(P.lt(a), P.gt(b), False)

    @staticmethod
    def between(a, b):
        return Both(P.gte(a), P.lt(b), True)

    @staticmethod
    def and_(a, b):
        return Both(a, b, True)

    @staticmethod
    def or_(a, b):
        return Both(a, b, False)

    @staticmethod
    def not_(a):
        return a.negate()


def _add_text(name: str, test) -> None:
    for fold, ending in ((False, ""), (True, "_ignore_case")):
        pair = _regex(fold) if name == "matches_regex" else _text(test, fold)

        def plain(value, pair=pair):
            return Test(pair, _values(value))

        def negated(value, pair=pair):
            return Test(pair, _values(value), True)

        setattr(P, name + ending, staticmethod(plain))
        setattr(P, "not_" + name + ending, staticmethod(negated))


for _name, _fn in {
    "equals": lambda x, v: x == F.lit(v),
    "starts_with": lambda x, v: F.startswith(x, F.lit(v)),
    "ends_with": lambda x, v: F.endswith(x, F.lit(v)),
    "contains": lambda x, v: F.contains(x, F.lit(v)),
    "matches_regex": None,
}.items():
    _add_text(_name, _fn)
