"""Numeric steps with the rounding and casts of 64-bit machine arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def round_half_up(x: Column) -> Column:
    """The nearest long; halves go towards positive infinity."""
    low = F.floor(x)
    return F.when(x - low >= 0.5, low + 1).otherwise(low).cast("long")


def wrap(x: Column, kind: str) -> Column:
    """Narrow a long to ``byte``, ``short`` or ``integer``, wrapping around as two's complement does."""
    bits = _BITS[kind]
    if bits == 64:
        return x.cast("long")
    span, half = 1 << bits, 1 << (bits - 1)
    low = F.pmod(x.cast("long"), F.lit(span).cast("long"))
    return F.when(low >= half, low - span).otherwise(low).cast(kind if kind != "integer" else "int")


def as_number(x: Column, kind: str) -> Column:
    """A number as another kind: fractions are cut off, integers wrap, null stays null."""
    if kind in ("float", "double"):
        return x.cast(kind)
    cut = F.when(x.cast("double") < 0, F.ceil(x)).otherwise(F.floor(x))
    return wrap(cut.cast("long"), kind)


def mean_over_all(x: Column) -> Column:
    """The sum over the number of all rows, nulls counted; null without rows or values."""
    return F.sum(x.cast("double")) / F.count(F.lit(1))


def sum_as_long(x: Column) -> Column:
    """The sum of the values cut to longs; null without values."""
    return F.sum(as_number(x, "long"))
