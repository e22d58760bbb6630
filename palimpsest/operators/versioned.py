"""Graphs and models over a version log: snapshots, histories, iteration, merge, typed indices."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.period import FOREVER
from ..plans.branches import MASTER
from ..plans.versions import VersionLog
from .graph import Graph
from .graph_history import ORIGIN_FIRST, branch_order, coordinates, previous_neighbourhood
from .indexing import IndexManager
from .model import Metamodel, Model

VERTICES, EDGES, VARIABLES = "vertex", "edge", "variable"
#: Snapshots that one iteration over whole elements may name; coordinates and changes have no such bound.
MAX_SNAPSHOTS = 10_000


class VersionedGraph:
    """A log whose keyspaces ``vertex`` and ``edge`` are a graph; edges have the payload ``src, dst``.

    ``vertex_columns`` and ``edge_columns`` name the payload that each kind of element shows.
    """

    def __init__(self, log: VersionLog, vertex_columns: list[str], edge_columns: list[str]):
        self.log, self.vertex_columns, self.edge_columns = log, vertex_columns, edge_columns

    def at(self, branch: str = MASTER, ts: int = FOREVER) -> Graph:
        """The graph that a read at (branch, timestamp) sees."""
        def part(keyspace, columns):
            return self.log.snapshot(branch, ts, F.col("keyspace") == keyspace).select(F.col("key").alias("id"), *columns)

        return Graph(part(VERTICES, self.vertex_columns), part(EDGES, ["src", "dst", *self.edge_columns]))

    def variables(self, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        return self.log.snapshot(branch, ts, F.col("keyspace") == VARIABLES).select("key", *self.log.payload)

    def history(self, kind: str, element: str, branch: str = MASTER, ts: int = FOREVER, **bounds) -> DataFrame:
        """Timestamps at which a vertex or an edge changed, latest first."""
        return self.log.history(element, kind, branch, ts, **bounds)

    def last_modification(self, kind: str, ids: DataFrame, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, last_modified`` of the elements that ``ids`` names as ``key``."""
        return self.log.last_modification(ids, kind, branch, ts)

    def modifications(self, kind: str, lo: int, hi: int, branch: str = MASTER) -> DataFrame:
        return self.log.modifications(lo, hi, kind, branch).select("key", "ts")

    def changed_at(self, kind: str, ts: int, branch: str = MASTER) -> DataFrame:
        """The vertices, edges or variables that the commit at ``ts`` changed."""
        return self.log.changed_keys_at(ts, branch, kind).select("key")

    def iterate(self, branches: list[str] | None = None, order: str = ORIGIN_FIRST) -> GraphIterator:
        names = branch_order(self.log.branches, order)
        return GraphIterator(self, tuple(n for n in names if branches is None or n in branches))


@dataclass(frozen=True)
class GraphIterator:
    """Branches, then timestamps of their commits, then what is to be seen at each of them."""

    graph: VersionedGraph
    branches: tuple[str, ...]
    lo: int = 0
    hi: int = FOREVER
    most: int | None = None
    keyspace: str | None = None
    key: str | None = None
    only: Callable[[Column], Column] | None = None
    head: bool = False

    def before(self, ts: int) -> GraphIterator:
        return replace(self, hi=min(self.hi, ts - 1))

    def after(self, ts: int) -> GraphIterator:
        return replace(self, lo=max(self.lo, ts + 1))

    def latest(self, n: int) -> GraphIterator:
        """The last ``n`` commits of each branch."""
        return replace(self, most=n)

    def where(self, condition: Callable[[Column], Column]) -> GraphIterator:
        return replace(self, only=condition)

    def history_of(self, kind: str, element: str) -> GraphIterator:
        return replace(self, keyspace=kind, key=element)

    def at_head(self) -> GraphIterator:
        return replace(self, head=True)

    def coordinates(self) -> DataFrame:
        """``branch, place, at``: branches by place; a branch's commits are in descending order of ``at``."""
        most = 1 if self.head else self.most
        if self.only is None:
            at = coordinates(self.graph.log, list(self.branches), self.lo, self.hi, self.keyspace, self.key, most)
        else:
            from pyspark.sql import Window

            at = coordinates(self.graph.log, list(self.branches), self.lo, self.hi, self.keyspace, self.key).filter(self.only(F.col("at")))
            if most is not None:
                w = Window.partitionBy("branch").orderBy(F.desc("at"))
                at = at.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")
        place = F.coalesce(*[F.when(F.col("branch") == b, F.lit(i)) for i, b in enumerate(self.branches)])
        return at.select("branch", place.alias("place"), "at")

    def elements(self, *kinds: str) -> DataFrame:
        """``branch, at, kind, id``: all vertices, edges or both that are there at each coordinate.

        The coordinates, at most MAX_SNAPSHOTS, are part of the plan, so versions are read once for
        each branch and given to the snapshots inside their period; nothing is joined.
        """
        found = self.coordinates().limit(MAX_SNAPSHOTS + 1).collect()
        if len(found) > MAX_SNAPSHOTS:
            raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots of whole elements")
        out = None
        for b in self.branches:
            times = sorted(r["at"] for r in found if r["branch"] == b)
            v = self.graph.log.validity(b, FOREVER, F.col("keyspace").isin(list(kinds or (VERTICES, EDGES)))).filter("op = 'P'")
            inside = F.filter(F.array(*[F.lit(t) for t in times]).cast("array<bigint>"), lambda t: (t >= F.col("valid_from")) & (t < F.col("valid_to")))
            rows = v.select(F.lit(b).alias("branch"), F.explode(inside).alias("at"), F.col("keyspace").alias("kind"), F.col("key").alias("id"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def changed(self, *kinds: str) -> DataFrame:
        """``branch, at, kind, id``: the elements that changed at each coordinate."""
        rows = self.graph.log.rows.filter(F.col("keyspace").isin(list(kinds or (VERTICES, EDGES))))
        rows = rows.select("branch", F.col("ts").alias("at"), F.col("keyspace").alias("kind"), F.col("key").alias("id")).distinct()
        return rows.join(self.coordinates().select("branch", "at"), ["branch", "at"], "left_semi")

    def changed_with_neighbours(self, branch: str = MASTER) -> DataFrame:
        """``key, at, neighbour`` of the changed vertices of one branch, as it was just before."""
        changed = self.changed(VERTICES).filter(F.col("branch") == branch).select(F.col("id").alias("key"), "at")
        edges = self.graph.log
        own = VersionLog(edges.rows.filter(F.col("keyspace") == EDGES), edges.branches)
        return previous_neighbourhood(changed, own, branch)


class VersionedModel:
    """A log whose keyspace ``object`` holds objects and ``link`` their links, over a metamodel."""

    OBJECTS, LINKS = "object", "link"

    def __init__(self, metamodel: Metamodel, log: VersionLog, attributes: list[str]):
        self.metamodel, self.log, self.attributes = metamodel, log, attributes

    def at(self, branch: str = MASTER, ts: int = FOREVER) -> Model:
        objects = self.log.snapshot(branch, ts, F.col("keyspace") == self.OBJECTS).select(F.col("key").alias("id"), "eclass", *self.attributes)
        links = self.log.snapshot(branch, ts, F.col("keyspace") == self.LINKS).select("src", "dst", "ref", "pos")
        return Model(self.metamodel, objects, links)

    def history(self, element: str, branch: str = MASTER, ts: int = FOREVER, **bounds) -> DataFrame:
        return self.log.history(element, self.OBJECTS, branch, ts, **bounds)

    def modifications(self, lo: int, hi: int, branch: str = MASTER) -> DataFrame:
        return self.log.modifications(lo, hi, self.OBJECTS, branch).select("key", "ts")


    def changes(self, after: Model, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """What turns the model that (branch, timestamp) sees into ``after``, as changes to commit."""
        snap, payload = self.log.snapshot(branch, ts), self.log.payload
        columns = ["eclass", *self.attributes]
        old = snap.filter(F.col("keyspace") == self.OBJECTS).select("key", F.struct(*columns).alias("old"))
        new = after.objects.select(F.col("id").alias("key"), F.struct(*columns).alias("new"))
        both = old.join(new, "key", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        op = F.when(F.col("new").isNull(), "D").otherwise("P").alias("op")
        objects = both.select(F.lit(self.OBJECTS).alias("keyspace"), "key", op, *[F.col(f"new.{c}").alias(c) for c in columns])
        ends = ["src", "dst", "ref", "pos"]
        place = F.coalesce("pos", F.lit(-1)).alias("__pos")
        held = snap.filter(F.col("keyspace") == self.LINKS).select("key", *ends, place)
        wanted = after.links.select(*ends, place)
        on = ["src", "dst", "ref", "__pos"]
        gone = held.join(wanted, on, "left_anti").select(F.lit(self.LINKS).alias("keyspace"), "key", F.lit("D").alias("op"))
        made = wanted.join(held, on, "left_anti")
        made = made.select(F.lit(self.LINKS).alias("keyspace"), F.concat_ws("|", "src", "ref", "dst", "__pos").alias("key"), F.lit("P").alias("op"), *ends)
        out = objects.unionByName(gone, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
        missing = [c for c in payload if c not in out.columns]
        out = out.withColumns({c: F.lit(None).cast(self.log.rows.schema[c].dataType) for c in missing})
        return out.select("keyspace", "key", "op", *payload)


def _merge_rows(before: DataFrame, mine: DataFrame, head: DataFrame, fixed: tuple[str, ...] = ()) -> DataFrame:
    """What the head becomes: what one side changed since ``before`` is taken, of what both did, mine.

    Elements that this side removed go, new ones come, with their properties over those of the head;
    of changed ones only what was changed is written, and one that the head lacks by now stays away.
    ``fixed`` columns (the ends of edges) go together with the element if this side changed any.
    """
    columns = [c for c in before.columns if c != "id"]
    sides = [d.select("id", F.struct(*columns).alias(n)) for d, n in ((before, "b"), (mine, "m"), (head, "h"))]
    rows = sides[2].join(sides[1], "id", "full_outer").join(sides[0], "id", "left")
    b, m, h = (F.col(n) for n in "bmh")
    new, gone = b.isNull() & m.isNotNull(), b.isNotNull() & m.isNull()
    stays = F.when(gone, False).when(new, True).otherwise(h.isNotNull())
    moved = F.lit(False)
    for c in fixed:
        moved = moved | ~m[c].eqNullSafe(b[c])

    def value(c: str) -> Column:
        taken = F.when(~m[c].eqNullSafe(b[c]), m[c]).otherwise(h[c])
        return F.when(new, F.coalesce(m[c], h[c])).when(m.isNull(), h[c]).when(moved, m[c]).otherwise(taken)

    return rows.filter(stays).select("id", *[value(c).alias(c) for c in columns])


def merge_graphs(before: Graph, mine: Graph, head: Graph) -> Graph:
    """The head with the changes that ``mine`` made to ``before``, as a commit over a moved head does.

    Vertices and edges are merged property by property. An edge whose ends are not there after the
    merge goes. An edge that is new on both sides with other ends is an error when it is read.
    """
    vertices = _merge_rows(before.vertices, mine.vertices, head.vertices)
    both = mine.edges.join(before.edges.select("id"), "id", "left_anti").alias("m").join(head.edges.alias("h"), "id")
    clash = both.filter("m.src <> h.src or m.dst <> h.dst").select("id").withColumn("__clash", F.lit(True))
    edges = _merge_rows(before.edges, mine.edges, head.edges, ("label", "src", "dst")).join(clash, "id", "left")
    bad = F.raise_error(F.concat(F.lit("the edge was made twice with other ends: "), F.col("id"))).cast("string")
    edges = edges.withColumn("id", F.when(F.col("__clash"), bad).otherwise(F.col("id"))).drop("__clash")
    ids = vertices.select("id")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return Graph(vertices.select(*before.vertices.columns), edges.select(*before.edges.columns))


class IndexBuilder:
    """``string_index().on_vertex_property("name")...build()``: a typed index on one kind of element."""

    def __init__(self, manager: ElementIndices):
        self._manager, self._kind, self._of, self._property = manager, None, None, None
        self._branch, self._from, self._until, self._clean = MASTER, 0, FOREVER, False

    def string_index(self) -> IndexBuilder:
        return self._set(_kind="string")

    def long_index(self) -> IndexBuilder:
        return self._set(_kind="long")

    def double_index(self) -> IndexBuilder:
        return self._set(_kind="double")

    def on_vertex_property(self, name: str) -> IndexBuilder:
        return self._set(_of=VERTICES, _property=name)

    def on_edge_property(self, name: str) -> IndexBuilder:
        return self._set(_of=EDGES, _property=name)

    def on_attribute(self, name: str) -> IndexBuilder:
        return self._set(_of=VersionedModel.OBJECTS, _property=name)

    def on_branch(self, name: str) -> IndexBuilder:
        return self._set(_branch=name)

    def valid(self, since: int = 0, until: int = FOREVER) -> IndexBuilder:
        return self._set(_from=since, _until=until)

    def assume_no_prior_values(self) -> IndexBuilder:
        return self._set(_clean=True)

    def _set(self, **changes) -> IndexBuilder:
        vars(self).update(changes)
        return self

    def build(self):
        if self._kind is None or self._of is None:
            raise ValueError("an index needs a type and a property")
        return self._manager.create(
            f"{self._of}.{self._property}", self._kind, self._property, self._branch, self._from, self._until, self._clean
        )


class ElementIndices(IndexManager):
    """Indices on properties of vertices and edges, or on attributes of objects, by kind and name."""

    def builder(self) -> IndexBuilder:
        return IndexBuilder(self)

    def indexed(self, kind: str, branch: str = MASTER, ts: int = FOREVER) -> list[str]:
        """The properties of one kind of element that have an index there which is not dirty."""
        return sorted(n.split(".", 1)[1] for n, x in self.find(branch, ts).items() if n.startswith(f"{kind}.") and not x.dirty)

    def drop(self, kind: str, name: str, branch: str = MASTER) -> None:
        self.delete(f"{kind}.{name}", branch)

    def values(self, kind: str, name: str, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, value`` of one index, read without the elements' other properties."""
        rows = self.log.snapshot(branch, ts, F.col("keyspace") == kind)
        _, column = self.columns(rows, [f"{kind}.{name}"], branch, ts)[f"{kind}.{name}"]
        return rows.select("key", F.explode(column).alias("value"))
