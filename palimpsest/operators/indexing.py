"""Secondary indices, queries over them, sorting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.period import FOREVER
from ..functions.predicates import STRING, And, Condition, Or, Where, to_column, where
from ..plans.branches import MASTER
from ..plans.versions import DEFAULT, VersionLog

_TYPES = {"string": "string", "long": "bigint", "double": "double"}


class DirtyIndex(RuntimeError):
    """The index must be built anew before it is used."""


@dataclass
class Index:
    """A named, typed, multi-valued index: ``extract`` gives the value or array of values of a row."""

    name: str
    kind: str
    extract: Callable[[], Column]
    branch: str = MASTER
    valid_from: int = 0
    valid_to: int = FOREVER
    dirty: bool = False
    parent: str | None = None

    def values(self, is_array: bool) -> Column:
        """Valid values as an array: nulls and blank strings are none."""
        c = self.extract()
        a = (c if is_array else F.array(c)).cast(f"array<{_TYPES[self.kind]}>")
        if self.kind == STRING:
            keep = F.filter(a, lambda v: v.isNotNull() & (F.trim(v) != ""))
        else:
            keep = F.filter(a, lambda v: v.isNotNull())
        return F.array_distinct(F.coalesce(keep, F.array().cast(f"array<{_TYPES[self.kind]}>")))


class IndexManager:
    """The indices of a log. They are expressions over a snapshot, inherited down the branch tree.

    A log may have a boolean payload column ``indexed``; rows where it is false stay out of all
    indices, as if they had no values.
    """

    def __init__(self, log: VersionLog):
        self.log = log
        self._all: list[Index] = []

    def create(
        self, name: str, kind: str, extract: Callable[[], Column] | str, branch: str = MASTER, valid_from: int = 0,
        valid_to: int = FOREVER, assume_no_prior_values: bool = False,
    ) -> Index:
        if kind not in _TYPES:
            raise ValueError(f"indices hold {', '.join(_TYPES)}, not {kind}")
        for x in self._all:
            if x.name == name and x.branch == branch and x.valid_from < valid_to and valid_from < x.valid_to:
                raise ValueError(f"index {name!r} exists on branch {branch!r} in that period")
        column = extract
        made = Index(name, kind, (lambda: F.col(column)) if isinstance(column, str) else column, branch, valid_from, valid_to)
        made.dirty = not assume_no_prior_values
        self._all.append(made)
        return made

    def find(self, branch: str = MASTER, ts: int = FOREVER) -> dict[str, Index]:
        """The indices that apply at (branch, ts): own ones before inherited ones."""
        out: dict[str, Index] = {}
        for a in self.log.branches.ancestry(branch, ts):
            for x in self._all:
                at = min(ts, a.hi)
                if x.branch == a.branch and x.valid_from <= at and (at < x.valid_to or x.valid_to == FOREVER):
                    out.setdefault(x.name, x)
        return out

    def list(self, branch: str | None = None) -> list[Index]:
        return [x for x in self._all if branch is None or x.branch == branch]

    def dirty(self) -> list[Index]:
        return [x for x in self._all if x.dirty]

    def mark_all_dirty(self) -> None:
        for x in self._all:
            x.dirty = True

    def reindex_all(self, force: bool = False) -> None:
        """Indices are expressions, so there is nothing to build; what was dirty is good again."""
        for x in self._all:
            x.dirty = False

    def delete(self, name: str, branch: str = MASTER) -> None:
        self._all = [x for x in self._all if (x.name, x.branch) != (name, branch)]

    def set_end(self, name: str, valid_to: int, branch: str = MASTER) -> None:
        for x in self._all:
            if (x.name, x.branch) == (name, branch):
                x.valid_to = valid_to

    def clear(self) -> None:
        self._all = []

    def columns(self, rows: DataFrame, names, branch: str = MASTER, ts: int = FOREVER) -> dict[str, tuple[str, Column]]:
        found = self.find(branch, ts)
        out = {}
        for name in names:
            if name in found:
                x = found[name]
                if x.dirty:
                    raise DirtyIndex(name)
                is_array = rows.select(x.extract()).schema[0].dataType.typeName() == "array"
                values = x.values(is_array)
                if "indexed" in rows.columns:  # rows put without index maintenance have no values
                    none = F.array().cast(f"array<{_TYPES[x.kind]}>")
                    values = F.when(F.coalesce(F.col("indexed"), F.lit(True)), values).otherwise(none)
                out[name] = (x.kind, values)
        return out

    def contents(self, name: str, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``value, keys``: the keys of each value."""
        return self._exploded(name, keyspace, branch, ts).groupBy("value").agg(F.sort_array(F.collect_set("key")).alias("keys"))

    def values_by_key(self, name: str, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, values``: the values of each key that has any."""
        return self._exploded(name, keyspace, branch, ts).groupBy("key").agg(F.sort_array(F.collect_set("value")).alias("values"))

    def _exploded(self, name, keyspace, branch, ts) -> DataFrame:
        snap = self.log.snapshot(branch, ts, F.col("keyspace") == keyspace)
        cols = self.columns(snap, [name], branch, ts)
        if name not in cols:
            raise KeyError(f"no index is named {name!r}")
        return snap.select("key", F.explode(cols[name][1]).alias("value"))


@dataclass(frozen=True)
class SortKey:
    """One sort key: values reduce to the least (ascending) or greatest; missing ones go last, or first."""

    index: str
    descending: bool = False
    ignore_case: bool = False
    nulls_first: bool = False

    def column(self, kind: str, values: Column) -> Column:
        if self.ignore_case and kind == STRING:
            values = F.transform(values, F.lower)
        v = F.array_max(values) if self.descending else F.array_min(values)
        if self.descending:
            return v.desc_nulls_first() if self.nulls_first else v.desc_nulls_last()
        return v.asc_nulls_first() if self.nulls_first else v.asc_nulls_last()


class Query:
    """``Query(indices).in_keyspace(...).where(cond)...`` with finalisers that give DataFrames."""

    def __init__(self, indices: IndexManager, branch: str = MASTER, ts: int = FOREVER):
        self.indices, self.branch, self.ts = indices, branch, ts
        self.keyspace, self.condition, self.keys = DEFAULT, None, ()

    def in_keyspace(self, keyspace: str) -> Query:
        self.keyspace = keyspace
        return self

    def in_default_keyspace(self) -> Query:
        return self.in_keyspace(DEFAULT)

    def where(self, condition: Condition) -> Query:
        self.condition = condition if self.condition is None else self.condition & condition
        return self

    def sort_by(self, *keys: SortKey) -> Query:
        self.keys = keys
        return self

    def rows(self) -> DataFrame:
        snap = self.indices.log.snapshot(self.branch, self.ts, F.col("keyspace") == self.keyspace)
        names = [n for n, _ in _names(self.condition)] if self.condition is not None else []
        cols = self.indices.columns(snap, {*names, *(k.index for k in self.keys)}, self.branch, self.ts)
        out = snap if self.condition is None else snap.filter(to_column(self.condition, cols))
        if self.keys:
            missing = [k.index for k in self.keys if k.index not in cols]
            if missing:
                raise KeyError(f"no index is named {missing[0]!r}")
            out = out.orderBy(*[k.column(*cols[k.index]) for k in self.keys], F.col("key").asc())
        return out

    def get_keys(self) -> DataFrame:
        return self.rows().select("key")

    def get_qualified_keys(self) -> DataFrame:
        return self.rows().select("keyspace", "key")

    def get_result(self) -> DataFrame:
        return self.rows().select("key", *self.indices.log.payload)

    def get_qualified_result(self) -> DataFrame:
        return self.rows().select("keyspace", "key", *self.indices.log.payload)

    def get_values(self) -> DataFrame:
        return self.rows().select(*self.indices.log.payload)

    def get_values_as_set(self) -> DataFrame:
        return self.get_values().distinct()

    def count(self) -> DataFrame:
        return self.rows().agg(F.count(F.lit(1)).alias("n"))


def _names(c: Condition):
    from ..functions.predicates import indices_of

    return sorted(indices_of(c))


def page(rows: DataFrame, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ordered rows."""
    return rows.offset(size * number).limit(size)


__all__ = ["And", "Condition", "DirtyIndex", "Index", "IndexManager", "Or", "Query", "SortKey", "Where", "page", "where"]
