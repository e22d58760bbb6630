"""The branch tree and the ancestry that a read follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MASTER = "master"


@dataclass(frozen=True)
class Branch:
    name: str
    origin: str | None = None
    branching_ts: int = 0


@dataclass(frozen=True)
class Ancestor:
    """A branch that a read sees, up to and including ``hi``; 0 is the branch itself."""

    branch: str
    depth: int
    hi: int


class BranchTree:
    """Branches by name; each has an origin but the root. A small dimension, kept as plain metadata."""

    def __init__(self, branches: list[Branch] | None = None):
        self._by: dict[str, Branch] = {}
        for b in branches or [Branch(MASTER)]:
            self._add(b)

    def _add(self, b: Branch) -> None:
        if b.name in self._by:
            raise ValueError(f"branch {b.name!r} exists")
        if b.origin is not None and b.origin not in self._by:
            raise ValueError(f"origin {b.origin!r} of branch {b.name!r} does not exist")
        self._by[b.name] = b

    def create(self, name: str, origin: str = MASTER, branching_ts: int = 0) -> Branch:
        b = Branch(name, origin, branching_ts)
        self._add(b)
        return b

    def exists(self, name: str) -> bool:
        return name in self._by

    def get(self, name: str) -> Branch:
        if name not in self._by:
            raise KeyError(f"there is no branch {name!r}")
        return self._by[name]

    def names(self) -> list[str]:
        return list(self._by)

    def all(self) -> list[Branch]:
        return list(self._by.values())

    def children(self, name: str, recursive: bool = False) -> list[str]:
        own = [b.name for b in self._by.values() if b.origin == name]
        if not recursive:
            return own
        return [x for c in own for x in (c, *self.children(c, True))]

    def delete_recursively(self, name: str) -> list[str]:
        """Remove a branch and all that come from it; the root stays. Returns what went."""
        if self.get(name).origin is None:
            raise ValueError("the root branch cannot be deleted")
        gone = [name, *self.children(name, True)]
        for n in gone:
            del self._by[n]
        return gone

    def actual_branch(self, name: str, ts: int) -> str:
        """The branch that holds what a read at ``ts`` sees: up the tree while branching is not before."""
        b = self.get(name)
        while b.origin is not None and b.branching_ts >= ts:
            b = self.get(b.origin)
        return b.name

    def ancestry(self, name: str, ts: int) -> list[Ancestor]:
        """The branch and its origins, each up to the timestamp where the one below left it."""
        out, hi, b = [], ts, self.get(name)
        while True:
            out.append(Ancestor(b.name, len(out), hi))
            if b.origin is None:
                return out
            hi = min(hi, b.branching_ts)
            b = self.get(b.origin)


def visible(ancestry: list[Ancestor], branch: Column, ts: Column) -> Column:
    """Which log rows a read sees. Literals only, so the filter reaches the scan."""
    out = F.lit(False)
    for a in ancestry:
        out = out | ((branch == a.branch) & (ts <= a.hi))
    return out


def depth(ancestry: list[Ancestor], branch: Column) -> Column:
    out = F.lit(None).cast("int")
    for a in ancestry:
        out = F.when(branch == a.branch, F.lit(a.depth)).otherwise(out)
    return out
