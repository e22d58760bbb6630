"""Half-open validity periods as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = (1 << 63) - 1


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


@dataclass(frozen=True)
class Period:
    """``[lower, upper)`` in milliseconds; the bounds are columns. Empty periods relate to nothing."""

    lower: Column
    upper: Column

    @staticmethod
    def of(lower, upper=FOREVER) -> Period:
        return Period(_col(lower), _col(upper))

    @staticmethod
    def empty() -> Period:
        return Period.of(0, 0)

    @staticmethod
    def eternal() -> Period:
        return Period.of(0)

    @staticmethod
    def point(ts) -> Period:
        return Period(_col(ts), _col(ts) + 1)

    def is_empty(self) -> Column:
        return self.lower >= self.upper

    def _both(self, other: Period, relation: Column) -> Column:
        return ~self.is_empty() & ~other.is_empty() & relation

    def contains(self, other) -> Column:
        if isinstance(other, Period):
            return self._both(other, (self.lower <= other.lower) & (self.upper >= other.upper))
        return (self.lower <= _col(other)) & (_col(other) < self.upper)

    def overlaps(self, other: Period) -> Column:
        return self._both(other, (self.lower < other.upper) & (other.lower < self.upper))

    def adjacent_to(self, other: Period) -> Column:
        return self._both(other, (self.lower == other.upper) | (self.upper == other.lower))

    def before(self, other) -> Column:
        if isinstance(other, Period):
            return self._both(other, self.lower < other.lower)
        return ~self.is_empty() & (self.upper <= _col(other))

    def after(self, other) -> Column:
        if isinstance(other, Period):
            return self._both(other, self.lower > other.lower)
        return ~self.is_empty() & (self.lower > _col(other))

    def strictly_before(self, other: Period) -> Column:
        return self._both(other, self.upper <= other.lower)

    def strictly_after(self, other: Period) -> Column:
        return self._both(other, self.lower >= other.upper)

    def is_open_ended(self) -> Column:
        return self.upper == F.lit(FOREVER)

    def length(self) -> Column:
        return F.greatest(self.upper - self.lower, F.lit(0))

    def with_upper(self, upper) -> Period:
        return Period(self.lower, _col(upper))

    def intersection(self, other: Period) -> Period:
        """The common part; the empty period ``[0, 0)`` if there is none."""
        on = self.overlaps(other)
        zero = F.lit(0).cast("long")
        return Period(
            F.when(on, F.greatest(self.lower, other.lower)).otherwise(zero),
            F.when(on, F.least(self.upper, other.upper)).otherwise(zero),
        )

    def order_key(self) -> Column:
        """Periods sort by their lower bound."""
        return self.lower
