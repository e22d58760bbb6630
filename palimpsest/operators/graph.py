"""A property graph over two keyspaces, and traversals as joins.

``vertices`` has ``id, label`` and property columns, ``edges`` has ``id, label, src, dst`` and
property columns. A traversal is a DataFrame of traversers: the element each stands on, the values of
named steps, and, once a step has looked at the element, its columns. So ``V().has(...)`` is a filter
over the scan of the vertices, after a step along edges the first look at a vertex is a join, and
further ones are not; a step onto an edge takes its columns along. What no step asks for is pruned. Every step is a projection, filter or join, so
multiplicities are those of a bag and Catalyst sees the whole traversal at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import cut_lineage
from ..plans.pieces import joined

VERTEX, EDGE, VALUE = "vertex", "edge", "value"
#: What the columns of the current element are called inside a traversal.
OWN = "__own_"


class Graph:
    """``on_full_scan(kind)`` is told of traversals that start from all vertices or edges."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, on_full_scan: Callable[[str], None] | None = None):
        self.vertices, self.edges, self.on_full_scan = vertices, edges, on_full_scan

    def V(self, *ids: str) -> Traversal:  # noqa: N802
        return self._start(VERTEX, self.vertices, ids)

    def E(self, *ids: str) -> Traversal:  # noqa: N802
        return self._start(EDGE, self.edges, ids)

    def inject(self, values: DataFrame, column: str) -> Traversal:
        return Traversal(self, VALUE, values.select(F.col(column).alias("it")))

    def _start(self, kind: str, rows: DataFrame, ids) -> Traversal:
        if any(not isinstance(i, str) for i in ids):
            raise TypeError("element ids are strings")
        if not ids and self.on_full_scan is not None:
            self.on_full_scan(kind)
        return replace(self.of(kind, rows.filter(F.col("id").isin(list(ids)))), ids=ids) if ids else self.of(kind, rows)

    def of(self, kind: str, rows: DataFrame) -> Traversal:
        """A traversal from some rows of the table of vertices or edges."""
        return Traversal(self, kind, rows.select(F.col("id").alias("it"), *[F.col(c).alias(OWN + c) for c in rows.columns if c != "id"]))

    def dangling_edges(self) -> DataFrame:
        """Edges of which an end is not there: none, if the graph is sound."""
        ids = self.vertices.select("id")
        e = self.edges
        bad = [joined(e.select("id", end), ids.withColumnRenamed("id", end), end, "left_anti").select("id") for end in ("src", "dst")]
        return bad[0].unionByName(bad[1]).distinct()


@dataclass(frozen=True)
class Traversal:
    """``it`` is the current element's id or the current value; other columns of ``rows`` are named steps.

    ``state`` has the current element's columns beside them, if they are there already. ``ids`` are
    those among which the current elements are, as long as they are known.
    """

    graph: Graph
    kind: str
    state: DataFrame
    names: tuple[tuple[str, str], ...] = ()
    stores: tuple[tuple[str, DataFrame], ...] = ()
    ids: tuple[str, ...] = ()

    # -- helpers -------------------------------------------------------------------------------

    @property
    def rows(self) -> DataFrame:
        return self.state.select("it", *self._carried()) if self._looked() else self.state

    def _with(self, state: DataFrame, kind: str | None = None) -> Traversal:
        return replace(self, state=state, kind=kind or self.kind, ids=())

    def _looked(self) -> bool:
        return any(c.startswith(OWN) for c in self.state.columns)

    def _carried(self) -> list[str]:
        return [c for c in self.state.columns if c != "it" and not c.startswith(OWN)]

    def _table(self) -> DataFrame:
        if self.kind == VALUE:
            raise TypeError("the step needs vertices or edges")
        return self.graph.vertices if self.kind == VERTEX else self.graph.edges

    def _look(self) -> DataFrame:
        """The traversers with their elements' columns."""
        t = self._table()
        if self._looked():
            return self.state
        return joined(self.state, t.select(F.col("id").alias("it"), *[F.col(c).alias(OWN + c) for c in t.columns if c != "id"]), "it")

    def _is_array(self, prop: str) -> bool:
        return self._table().schema[prop].dataType.typeName() == "array"

    # -- filters -------------------------------------------------------------------------------

    def has(self, prop: str, test=None) -> Traversal:
        """Elements whose property passes ``test`` (a predicate, a plain value, or none: is there)."""
        col = F.col(OWN + prop)
        if test is None:
            on = col.isNotNull()
        elif callable(test):
            on = test(col, self._is_array(prop))
        else:
            from ..functions.compare import P

            on = P.eq(test)(col, self._is_array(prop))
        return self._with(self._look().filter(on))

    def has_not(self, prop: str) -> Traversal:
        return self._with(self._look().filter(F.col(OWN + prop).isNull()))

    def has_label(self, *labels: str) -> Traversal:
        return self._with(self._look().filter(F.col(OWN + "label").isin(list(labels))))

    def has_id(self, *ids: str) -> Traversal:
        return self._with(self.state.filter(F.col("it").isin(list(ids))))

    def is_(self, test) -> Traversal:
        return self._with(self.state.filter(test(F.col("it"))))

    def filter(self, condition: Callable[[Column], Column], prop: str | None = None) -> Traversal:
        if prop is None:
            return self._with(self.state.filter(condition(F.col("it"))))
        return self._with(self._look().filter(condition(F.col(OWN + prop))))

    def where(self, sub: Callable[[Traversal], Traversal]) -> Traversal:
        """Traversers for which the sub-traversal finds anything: a semi join."""
        return self._exists(sub, "left_semi")

    def not_(self, sub: Callable[[Traversal], Traversal]) -> Traversal:
        return self._exists(sub, "left_anti")

    def and_(self, *subs) -> Traversal:
        out = self
        for s in subs:
            out = out.where(s)
        return out

    def or_(self, *subs) -> Traversal:
        hits = None
        for s in subs:
            found = self._seeds(s)
            hits = found if hits is None else hits.unionByName(found)
        return self._with(joined(self.state, hits.distinct(), "it", "left_semi"))

    def _once(self) -> Traversal:
        """Each element once, and its id as the column ``__seed``."""
        own = [c for c in self.state.columns if c.startswith(OWN)]
        rows = self.state.select("it", *own)
        return Traversal(self.graph, self.kind, (rows.dropDuplicates(["it"]) if own else rows.distinct()).withColumn("__seed", F.col("it")))

    def _seeds(self, sub) -> DataFrame:
        start = self._once()
        return sub(start).rows.select(F.col("__seed").alias("it")).distinct()

    def _exists(self, sub, how: str) -> Traversal:
        return self._with(joined(self.state, self._seeds(sub), "it", how))

    # -- navigation ----------------------------------------------------------------------------

    def _edges(self, labels) -> DataFrame:
        e = self.graph.edges
        return e.filter(F.col("label").isin(list(labels))) if labels else e

    def _step(self, labels, here: str, there: str, kind: str) -> DataFrame:
        e = self._edges(labels)
        if self.ids:
            e = e.filter(F.col(here).isin(list(self.ids)))
        own = [OWN + c for c in e.columns if c != "id"] if kind == EDGE else []
        e = e.select(F.col(here).alias("it"), F.col(there).alias("__next"), *[F.col(c.removeprefix(OWN)).alias(c) for c in own])
        return self._moved(joined(self.rows, e, "it"), own)

    def _moved(self, rows: DataFrame, own: list[str] = ()) -> DataFrame:
        """On to the element ``__next``, which a path that is kept takes in, and whose columns may be there."""
        longer = [F.concat("path", F.array(F.col("__next"))).alias(c) if c == "path" else F.col(c) for c in self._carried()]
        return rows.select(F.col("__next").alias("it"), *longer, *own)

    def out(self, *labels: str) -> Traversal:
        return self._with(self._step(labels, "src", "dst", VERTEX))

    def in_(self, *labels: str) -> Traversal:
        return self._with(self._step(labels, "dst", "src", VERTEX))

    def both(self, *labels: str) -> Traversal:
        return self._with(self.out(*labels).rows.unionByName(self.in_(*labels).rows))

    def out_e(self, *labels: str) -> Traversal:
        return self._with(self._step(labels, "src", "id", EDGE), EDGE)

    def in_e(self, *labels: str) -> Traversal:
        return self._with(self._step(labels, "dst", "id", EDGE), EDGE)

    def both_e(self, *labels: str) -> Traversal:
        return self._with(self.out_e(*labels).state.unionByName(self.in_e(*labels).state), EDGE)

    def _end(self, end: str) -> DataFrame:
        return self._moved(self._look().withColumn("__next", F.col(OWN + end)))

    def out_v(self) -> Traversal:
        return self._with(self._end("src"), VERTEX)

    def in_v(self) -> Traversal:
        return self._with(self._end("dst"), VERTEX)

    def both_v(self) -> Traversal:
        return self._with(self._end("src").unionByName(self._end("dst")), VERTEX)

    def other_v(self, came_from: str) -> Traversal:
        """The end of the edge that is not the vertex of the named step."""
        src, dst = F.col(OWN + "src"), F.col(OWN + "dst")
        return self._with(self._moved(self._look().withColumn("__next", F.when(src == F.col(came_from), dst).otherwise(src))), VERTEX)

    def closure(self, step: Callable[[Traversal], Traversal], include_start: bool = False, max_depth: int | None = None) -> Traversal:
        """What repeated steps reach, each element once per start: ``repeat(step).emit().dedup()``.

        A start is not part of its own closure, even on a cycle. The frontier grows by one join a
        round and loses what was reached before; every few rounds its lineage is cut.
        """
        seeds = self.rows.select("it").distinct().withColumn("__seed", F.col("it"))
        frontier = seen = cut_lineage(seeds)
        depth = 0
        while max_depth is None or depth < max_depth:
            nxt = step(Traversal(self.graph, self.kind, frontier)).rows.select("it", "__seed").distinct()
            frontier = cut_lineage(nxt.join(seen, ["it", "__seed"], "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
            depth += 1
            if depth % 8 == 0:
                seen = cut_lineage(seen)
        if not include_start:
            seen = seen.filter(F.col("it") != F.col("__seed"))
        back = self.rows.withColumnRenamed("it", "__seed").join(seen, "__seed")
        return self._with(back.select("it", *self._carried()))

    def repeat(self, step: Callable[[Traversal], Traversal], times: int, emit: bool = False) -> Traversal:
        """``repeat(step).times(n)``, every round's traversers with ``emit``; paths are counted apart."""
        now, out = self, None
        for _ in range(times):
            now = step(now)
            out = now.rows if out is None else out.unionByName(now.rows)
        return now._with(out) if emit else now

    def repeat_until(self, step: Callable[[Traversal], Traversal], until: Callable[[Traversal], Traversal], most: int) -> Traversal:
        """Repeat a step; traversers for which ``until`` finds anything come out, after ``most`` rounds the rest.

        A round names its traversers more than once, so each round's lineage is cut.
        """
        now, out = step(self), None
        for i in range(most):
            now = now._with(cut_lineage(now.rows))
            last = i + 1 == most or now.rows.isEmpty()
            done = now if last else now.where(until)
            out = done.rows if out is None else out.unionByName(done.rows)
            if last:
                break
            now = step(now.not_(until))
        return now._with(out)

    def simple_paths(self, step: Callable[[Traversal], Traversal], max_depth: int) -> DataFrame:
        """``path``: all paths of 1 to ``max_depth`` steps without a repeated element."""
        now, out = Traversal(self.graph, self.kind, self.rows.select("it")).with_path(), None
        for _ in range(max_depth):
            now = step(now).simple_path()
            out = now.rows if out is None else out.unionByName(now.rows)
        return out.select("path")

    # -- paths ---------------------------------------------------------------------------------

    def with_path(self) -> Traversal:
        """From here on the traversers keep the elements they pass, as the column ``path``."""
        return self._with(self.state.withColumn("path", F.array("it")))

    def path(self) -> DataFrame:
        """``path``: of each traverser the elements it has passed since ``with_path``."""
        return self.rows.select("path")

    def simple_path(self) -> Traversal:
        return self._with(self.state.filter(F.size(F.array_distinct("path")) == F.size("path")))

    def cyclic_path(self) -> Traversal:
        return self._with(self.state.filter(F.size(F.array_distinct("path")) < F.size("path")))

    def tree(self) -> DataFrame:
        """``path, n``: every beginning of the traversers' paths, and how many of them share it."""
        beginnings = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice(F.col("path"), F.lit(1), n))
        return self.rows.select(F.explode(beginnings).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))

    # -- side effects, sacks, patterns ---------------------------------------------------------

    def store(self, name: str) -> Traversal:
        """Remember the current elements under a name; ``cap`` gives them."""
        return replace(self, stores=(*self.stores, (name, self.rows.select("it"))))

    def cap(self, name: str) -> Traversal:
        """The elements that steps of that name have stored, as values."""
        out = None
        for n, rows in self.stores:
            if n == name:
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise KeyError(name)
        return replace(self, state=out, kind=VALUE, ids=())

    def side_effect(self, f: Callable[[Traversal], object]) -> Traversal:
        """Call ``f`` with the traversal, whose traversers go on as they are."""
        f(self)
        return self

    def local(self, sub: Callable[[Traversal], Traversal]) -> Traversal:
        """The sub-traversal for each traverser by itself, which for steps without an order is the same."""
        return sub(self)

    def local_limit(self, sub: Callable[[Traversal], Traversal], n: int) -> Traversal:
        """Of each element the first ``n`` results of the sub-traversal, in their order."""
        got = sub(self._once())
        w = Window.partitionBy("__seed").orderBy("it")
        first = got.rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).select("__seed", F.col("it").alias("__next"))
        rows = self.rows.join(first.withColumnRenamed("__seed", "it"), "it")
        return self._with(self._moved(rows), got.kind)

    def with_sack(self, start: Column) -> Traversal:
        return self._with(self.state.withColumn("sack", start))

    def sack(self, f: Callable[[Column, Column], Column], prop: str) -> Traversal:
        """Each traverser's sack becomes ``f(sack, property)``; without the property it stays."""
        value = F.col(OWN + prop)
        return self._with(self._look().withColumn("sack", F.when(value.isNull(), F.col("sack")).otherwise(f(F.col("sack"), value))))

    def match(self, *patterns: tuple[str, Callable[[Traversal], Traversal], str]) -> DataFrame:
        """A column for each name: bindings that meet all patterns (name, step, name).

        The first pattern begins at the current elements; each other one shares a name with those before.
        """
        out = None
        for start, step, end in patterns:
            if out is None:
                base = self._once()
            else:
                if start not in out.columns:
                    raise ValueError(f"nothing is called {start!r} yet")
                base = Traversal(self.graph, self.kind, out.select(F.col(start).alias("it")).distinct().withColumn("__seed", F.col("it")))
            pairs = step(base).rows.select(F.col("__seed").alias(start), F.col("it").alias(end)).distinct()
            out = pairs if out is None else out.join(pairs, [c for c in (start, end) if c in out.columns])
        return out

    # -- naming, branching ---------------------------------------------------------------------

    def as_(self, name: str) -> Traversal:
        return replace(self, state=self.state.withColumn(name, F.col("it")), names=(*self.names, (name, self.kind)))

    def select(self, name: str) -> Traversal:
        kind = dict(self.names)[name]
        return self._with(self.rows.select(F.col(name).alias("it"), *self._carried()), kind)

    back = select

    def except_named(self, name: str) -> Traversal:
        return self._with(self.state.filter(F.col("it") != F.col(name)))

    def except_(self, other: Traversal) -> Traversal:
        return self._with(self.state.join(other.rows.select("it").distinct(), "it", "left_anti"))

    def union(self, *subs: Callable[[Traversal], Traversal]) -> Traversal:
        parts = [s(self) for s in subs]
        rows = parts[0].rows
        for p in parts[1:]:
            rows = rows.unionByName(p.rows)
        return parts[0]._with(rows)

    def optional(self, sub: Callable[[Traversal], Traversal]) -> Traversal:
        return self.coalesce(sub, lambda t: t)

    def coalesce(self, *subs: Callable[[Traversal], Traversal]) -> Traversal:
        """Of each traverser the results of the first sub-traversal that has any."""
        rest, out, kind = self, None, self.kind
        for s in subs:
            got = s(rest)
            out, kind = (got.rows if out is None else out.unionByName(got.rows)), got.kind
            rest = rest.not_(s)
        return self._with(out, kind)

    def choose(self, test, yes, no) -> Traversal:
        a, b = yes(self.where(test)), no(self.not_(test))
        return a._with(a.rows.unionByName(b.rows))

    # -- values, order, aggregates -------------------------------------------------------------

    def values(self, *props: str) -> Traversal:
        """The properties' values, those of collections one by one; missing ones give none."""
        t = self._look()
        out = None
        for p in props:
            col = F.col(OWN + p)
            rows = t.withColumn("__v", F.explode(col) if self._is_array(p) else col).filter(F.col("__v").isNotNull())
            one = rows.select(F.col("__v").alias("it"), *self._carried())
            if len(props) > 1:
                one = one.withColumn("it", F.col("it").cast("string"))
            out = one if out is None else out.unionByName(one)
        return self._with(out, VALUE)

    def value_map(self, *props: str) -> DataFrame:
        """``it`` and a column for each property."""
        return self._look().select("it", *[F.col(OWN + p).alias(p) for p in props], *self._carried())

    def element_map(self) -> DataFrame:
        return self.value_map(*[c for c in self._table().columns if c != "id"])

    def label(self) -> Traversal:
        return self._with(self._look().select(F.col(OWN + "label").alias("it"), *self._carried()), VALUE)

    def map(self, f: Callable[[Column], Column]) -> Traversal:
        return self._with(self.rows.withColumn("it", f(F.col("it"))), VALUE)

    def flat_map(self, f: Callable[[Column], Column]) -> Traversal:
        return self._with(self.rows.withColumn("it", F.explode(f(F.col("it")))), VALUE)

    def unfold(self) -> Traversal:
        """Of values that are collections, their items."""
        return self.flat_map(lambda c: c)

    def identity(self) -> Traversal:
        return self

    def constant(self, value) -> Traversal:
        return self.map(lambda _: F.lit(value))

    def order_by(self, *keys: tuple[str, bool] | tuple[str, bool, bool]) -> DataFrame:
        """Rows ordered by (property, descending[, nulls first]), then by id. Missing values stay, last by default."""
        props = [k[0] for k in keys]
        by = []
        for k in keys:
            c = F.col(OWN + k[0])
            if self._is_array(k[0]):
                c = F.array_max(c) if k[1] else F.array_min(c)
            first = len(k) > 2 and k[2]
            by.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if k[1] else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        ordered = self._look().orderBy(*by, F.col("it").asc())
        return ordered.select("it", *[F.col(OWN + p).alias(p) for p in props])

    def order_with(self, key: Callable[[Column], Column]) -> DataFrame:
        """Rows ordered by an expression of the current element, then by the element."""
        return self.rows.orderBy(key(F.col("it")), "it")

    def dedup(self, *by: str) -> Traversal:
        return self._with(self.state.dropDuplicates(list(by) or ["it"]))

    def limit(self, n: int) -> Traversal:
        return self._with(self.state.limit(n))

    def range_(self, lo: int, hi: int) -> Traversal:
        """The traversers from place ``lo`` to before ``hi``, in order of the current element."""
        return self._with(self.state.orderBy("it").offset(lo).limit(hi - lo))

    def skip(self, n: int) -> Traversal:
        """All but the first ``n``, in order of the current element."""
        return self._with(self.state.orderBy("it").offset(n))

    def tail(self, n: int) -> Traversal:
        """The last ``n`` in order of the current element, in that order."""
        return self._with(self.state.orderBy(F.desc("it")).limit(n).orderBy("it"))

    def sample(self, fraction: float, seed: int = 0) -> Traversal:
        return self._with(self.state.sample(fraction, seed))

    coin = sample

    def count(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def aggregate(self, how: str) -> DataFrame:
        """``sum``, ``mean``, ``min`` or ``max`` of the current values."""
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how]
        return self.rows.agg(f("it").alias(how))

    def group_count(self, prop: str | None = None) -> DataFrame:
        key, rows = (F.col("it"), self.rows) if prop is None else (F.col(OWN + prop), self._look())
        return rows.groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("n"))

    def group(self, prop: str) -> DataFrame:
        return self._look().groupBy(F.col(OWN + prop).alias("group")).agg(F.sort_array(F.collect_list("it")).alias("members"))

    def fold(self) -> DataFrame:
        return self.rows.agg(F.sort_array(F.collect_list("it")).alias("members"))

    def project(self, **columns: Callable[[Traversal], Traversal]) -> DataFrame:
        """``it`` and for each name the sub-traversal's values as a sorted list."""
        base = self._once()
        out = self.rows
        for name, sub in columns.items():
            got = sub(base).rows.groupBy(F.col("__seed").alias("it")).agg(F.sort_array(F.collect_list("it")).alias(name))
            out = out.join(got, "it", "left")
        return out


def subgraph(graph: Graph, edges: Traversal) -> Graph:
    """The graph of some edges and their ends."""
    e = graph.edges.join(edges.rows.select(F.col("it").alias("id")).distinct(), "id", "left_semi")
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return Graph(graph.vertices.join(ends, "id", "left_semi"), e)


def _marked(rows: DataFrame, known: DataFrame, on: str, mark: str) -> DataFrame:
    """``rows`` with a column that is true where ``known`` has the row's value.

    Of what is known only values that the rows ask for are kept, so a large table is not sent about for a few rows.
    """
    asked = rows.select(on).distinct()
    hits = joined(known.select(on), asked, on, "left_semi").distinct().withColumn(mark, F.lit(True))
    return rows.join(hits.hint("merge"), on, "left")


def add_vertices(graph: Graph, rows: DataFrame) -> Graph:
    """New vertices; one whose id is there is an error when the result is read."""
    new = _marked(rows, graph.vertices, "id", "__there").withColumn(
        "id", F.when(F.col("__there"), F.raise_error(F.concat(F.lit("the vertex exists: "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    )
    return Graph(graph.vertices.unionByName(new.drop("__there"), allowMissingColumns=True), graph.edges)


def add_edges(graph: Graph, rows: DataFrame, check: bool = True) -> Graph:
    """New edges; one whose id is there, or whose ends are not, is an error when the result is read."""
    new = _checked(graph, rows) if check else rows
    return Graph(graph.vertices, graph.edges.unionByName(new, allowMissingColumns=True))


def _checked(graph: Graph, rows: DataFrame) -> DataFrame:
    new = _marked(rows, graph.edges, "id", "__there")
    for end in ("src", "dst"):
        new = _marked(new, graph.vertices.select(F.col("id").alias(end)), end, f"__{end}")
    bad = F.raise_error(F.concat(F.lit("the edge exists or an end is missing: "), F.col("id"))).cast("string")
    wrong = F.col("__there").isNotNull() | F.col("__src").isNull() | F.col("__dst").isNull()
    return new.withColumn("id", F.when(wrong, bad).otherwise(F.col("id"))).select(*rows.columns)


def merge_edges(graph: Graph, rows: DataFrame) -> Graph:
    """Edges that are there with the label and the ends keep their id and take the new properties; others are added."""
    on = ["label", "src", "dst"]
    props = [c for c in rows.columns if c not in ("id", *on)]
    old = joined(graph.edges, rows.select(*on, F.struct(F.lit(1).alias("hit"), *props).alias("__new")), on, "left")
    old = old.withColumns({c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)) for c in props})
    there = joined(graph.edges.select(*on), rows.select(*on).distinct(), on, "left_semi").distinct()
    new = _checked(graph, rows.join(there.hint("merge"), on, "left_anti").select(*rows.columns))
    return Graph(graph.vertices, old.select(*graph.edges.columns).unionByName(new, allowMissingColumns=True))


def remove_edges(graph: Graph, ids: DataFrame) -> Graph:
    return Graph(graph.vertices, joined(graph.edges, ids.select("id").distinct(), "id", "left_anti").select(*graph.edges.columns))


def set_edge_property(graph: Graph, ids: DataFrame, prop: str, value: Column | None) -> Graph:
    """Set a property of the edges with the given ids; null removes it."""
    return Graph(graph.vertices, set_property(Graph(graph.edges, graph.edges), ids, prop, value).vertices)


def set_property(graph: Graph, ids: DataFrame, prop: str, value: Column | None) -> Graph:
    """Set a vertex property of the given ids; null removes it."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    new = F.lit(None) if value is None else value
    v = graph.vertices.join(hit, "id", "left").withColumn(prop, F.when(F.col("__hit"), new).otherwise(F.col(prop))).drop("__hit")
    return Graph(v.select(*graph.vertices.columns), graph.edges)


def remove_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """Vertices go, and every edge that touches them."""
    ids = ids.select("id").distinct()
    e = graph.edges
    for end in ("src", "dst"):
        e = joined(e, ids.withColumnRenamed("id", end), end, "left_anti")
    return Graph(joined(graph.vertices, ids, "id", "left_anti"), e.select(*graph.edges.columns))
