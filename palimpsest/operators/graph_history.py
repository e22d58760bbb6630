"""Graph history: what changed between snapshots, restores, coordinates, triggers, validators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.branches import MASTER, BranchTree
from ..plans.versions import VersionLog

ORIGIN_FIRST, BRANCHING_TIMESTAMPS = "origin_first", "branching_timestamps"


def diff(before: DataFrame, after: DataFrame, payload: list[str]) -> DataFrame:
    """``key, status, before, after`` of keys that differ: NEW, REMOVED or CHANGED."""
    a = before.select("key", F.struct(*payload).alias("before"))
    b = after.select("key", F.struct(*payload).alias("after"))
    both = a.join(b, "key", "full_outer")
    status = F.when(F.col("before").isNull(), "NEW").when(F.col("after").isNull(), "REMOVED").otherwise("CHANGED")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("key", status.alias("status"), "before", "after")


def restore(log: VersionLog, keyspace: str, ts: int, branch: str = MASTER, keys: DataFrame | None = None) -> DataFrame:
    """Changes ``keyspace, key, op, <payload>`` that bring the head back to its state at ``ts``."""
    own = F.col("keyspace") == keyspace
    then, now = log.snapshot(branch, ts, own), log.snapshot(branch, where=own)
    if keys is not None:
        then, now = then.join(keys.select("key"), "key", "left_semi"), now.join(keys.select("key"), "key", "left_semi")
    d = diff(now, then, log.payload)
    op = F.when(F.col("status") == "REMOVED", "D").otherwise("P")
    return d.select(F.lit(keyspace).alias("keyspace"), "key", op.alias("op"), *[F.col(f"after.{c}").alias(c) for c in log.payload])


def restorable_edges(changes: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge changes split into those whose ends will be there and the ``key`` of those that fail."""
    ids = vertices.select("id")
    puts = changes.filter("op = 'P'")
    ok = puts.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    failed = puts.join(ok.select("key"), "key", "left_anti").select("key")
    return changes.filter("op = 'D'").unionByName(ok.select(*changes.columns)), failed


def branch_order(tree: BranchTree, order: str = ORIGIN_FIRST) -> list[str]:
    """All branches, origins before what comes from them, or by the time they were made."""
    if order == BRANCHING_TIMESTAMPS:
        return [b.name for b in sorted(tree.all(), key=lambda b: (b.origin is not None, b.branching_ts, b.name))]
    out, now = [], [b.name for b in tree.all() if b.origin is None]
    while now:
        out += sorted(now, key=lambda n: (tree.get(n).branching_ts, n))
        now = [c for n in now for c in tree.children(n)]
    return out


def coordinates(
    log: VersionLog, branches: list[str] | None = None, lo: int = 0, hi: int = (1 << 63) - 1, keyspace: str | None = None,
    key: str | None = None, limit: int | None = None,
) -> DataFrame:
    """``branch, at``: the commits of branches, latest first within each; of one key's changes if given."""
    names = branches or log.branches.names()
    rows = log.rows.filter(F.col("branch").isin(names) & F.col("ts").between(lo, hi))
    if keyspace is not None:
        rows = rows.filter(F.col("keyspace") == keyspace)
    if key is not None:
        rows = rows.filter(F.col("key") == key)
    at = rows.select("branch", F.col("ts").alias("at")).distinct()
    if limit is not None:
        at = at.withColumn("r", F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("at")))).filter(F.col("r") <= limit).drop("r")
    return at


def changed_with_previous(log: VersionLog, keyspace: str, branch: str = MASTER, lo: int = 0, hi: int = (1 << 63) - 1) -> DataFrame:
    """``key, at, removed, previous_at`` of every change in a keyspace: the key's last change before it."""
    rows = log.seen(branch, hi).filter(F.col("keyspace") == keyspace)
    w = Window.partitionBy("key").orderBy("ts", F.desc("depth"))
    rows = rows.select("key", F.col("ts").alias("at"), (F.col("op") == "D").alias("removed"), F.lag("ts").over(w).alias("previous_at"))
    return rows.filter(F.col("at") >= lo)


def previous_neighbourhood(changes: DataFrame, edges: VersionLog, branch: str = MASTER, src: str = "src", dst: str = "dst") -> DataFrame:
    """``key, at, neighbour``: what a changed vertex was joined to just before the change.

    ``edges`` is a log of edges with their ends as payload; an edge counts if it is valid at the
    coordinate's predecessor, the latest moment before ``at``.
    """
    v = edges.validity(branch).filter("op = 'P'").withColumnRenamed("key", "edge")
    ends = v.select(F.col(src).alias("key"), F.col(dst).alias("neighbour"), "valid_from", "valid_to").unionByName(
        v.select(F.col(dst).alias("key"), F.col(src).alias("neighbour"), "valid_from", "valid_to")
    )
    on = (F.col("valid_from") <= F.col("at") - 1) & (F.col("valid_to") > F.col("at") - 1)
    return changes.select("key", "at").join(ends, "key").filter(on).select("key", "at", "neighbour").distinct()


@dataclass(frozen=True)
class Rule:
    """A named condition that every row must meet."""

    name: str
    condition: Callable[[], Column]


def validate(rows: DataFrame, rules: list[Rule], key: str = "key") -> DataFrame:
    """``rule, key`` of every violation, in one pass over the rows."""
    broken = F.array(*[F.when(~F.coalesce(r.condition(), F.lit(False)), F.lit(r.name)) for r in rules])
    return rows.select(F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"), key)


NEW, PERSISTED, REMOVED, PROPERTY_CHANGED, EDGE_CHANGED, OBSOLETE = "NEW", "PERSISTED", "REMOVED", "PROPERTY_CHANGED", "EDGE_CHANGED", "OBSOLETE"


def lifecycle(before, after, touched: DataFrame | None = None) -> DataFrame:
    """``kind, id, status`` of all elements of two graphs, ``before`` and ``after`` a transaction.

    A vertex whose own columns are as before but whose edges came, went or changed ends is
    EDGE_CHANGED. Elements that ``touched`` (``kind, id``) names and neither graph has were made and
    removed on the way: OBSOLETE.
    """
    def states(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        columns = [c for c in a.columns if c != "id"]
        both = a.select("id", F.struct(*columns).alias("a")).join(b.select("id", F.struct(*columns).alias("b")), "id", "full_outer")
        status = F.when(F.col("a").isNull(), NEW).when(F.col("b").isNull(), REMOVED).when(~F.col("a").eqNullSafe(F.col("b")), PROPERTY_CHANGED)
        return both.select(F.lit(kind).alias("kind"), "id", status.otherwise(PERSISTED).alias("status"))

    def ends(g: DataFrame) -> DataFrame:
        e = g.select("id", "label", "src", "dst")
        return e.select("id", "label", "src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("vertex"))

    a, b = ends(before.edges), ends(after.edges)
    on = ["id", "label", "src", "dst", "vertex"]
    other = a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti")).select(F.col("vertex").alias("id"), F.lit(True).alias("edges")).distinct()
    vertices = states(before.vertices, after.vertices, "vertex").join(other, "id", "left")
    own = F.when((F.col("status") == PERSISTED) & F.col("edges"), EDGE_CHANGED).otherwise(F.col("status"))
    out = vertices.select("kind", "id", own.alias("status")).unionByName(states(before.edges, after.edges, "edge"))
    if touched is not None:
        never = touched.select("kind", "id").distinct().join(out, ["kind", "id"], "left_anti")
        out = out.unionByName(never.withColumn("status", F.lit(OBSOLETE)))
    return out


PRE_COMMIT, PRE_PERSIST, POST_PERSIST, POST_COMMIT = "pre_commit", "pre_persist", "post_persist", "post_commit"


class CancelCommit(RuntimeError):
    """A trigger stops the commit."""


@dataclass(frozen=True)
class TriggerContext:
    """What a trigger may look at: four states, each a DataFrame of ``keyspace, key, <payload>``."""

    store: object
    branch: str
    tx_ts: int
    changes: DataFrame
    before: VersionLog

    def ancestor(self) -> DataFrame:
        """What the transaction saw when it began."""
        return self.before.snapshot(self.branch, self.tx_ts).select("keyspace", "key", *self.before.payload)

    def pre_commit_store(self) -> DataFrame:
        """The head before this commit, with what others wrote meanwhile."""
        return self.before.snapshot(self.branch).select("keyspace", "key", *self.before.payload)

    def store_state(self) -> DataFrame:
        """The head as it is: after the commit, what was written is there."""
        return self.store.log.snapshot(self.branch).select("keyspace", "key", *self.before.payload)

    def current(self) -> DataFrame:
        """The head before the commit with this commit's changes."""
        old = self.pre_commit_store().join(self.changes.select("keyspace", "key"), ["keyspace", "key"], "left_anti")
        return old.unionByName(self.changes.filter("op = 'P'").select("keyspace", "key", *self.before.payload))


@dataclass
class Triggers:
    """Functions of a ``TriggerContext``, by name, run around a commit in order of priority."""

    found: dict[str, tuple[str, int, Callable]] = field(default_factory=dict)

    def create(self, name: str, timing: str, fn: Callable, priority: int = 0, overwrite: bool = False, if_absent: bool = False) -> bool:
        """Whether it was made. One that is there is an error, unless it is replaced or left as it is."""
        if name in self.found:
            if if_absent:
                return False
            if not overwrite:
                raise ValueError(f"trigger {name!r} exists")
        self.found[name] = (timing, priority, fn)
        return True

    def drop(self, name: str) -> bool:
        return self.found.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.found)

    def fire(self, timing: str, context: TriggerContext) -> DataFrame:
        """Run the triggers of one timing; one may give other changes, or raise CancelCommit."""
        changes = context.changes
        for _, (_, _, fn) in sorted(((n, t) for n, t in self.found.items() if t[0] == timing), key=lambda x: (-x[1][1], x[0])):
            found = fn(replace(context, changes=changes))
            changes = changes if found is None else found
        return changes


def commit_with_hooks(tx, triggers: Triggers, rules: list[Rule] = (), metadata: str | None = None) -> int:
    """Commit a transaction with its triggers and rules; violations leave the store as it was.

    PRE_COMMIT sees the transaction's own changes; PRE_PERSIST what is about to be written, once
    duplicates are gone and conflicts resolved, which is also what rules are held against.
    """
    store, branch = tx.store, tx.branch
    context = TriggerContext(store, branch, tx.ts, tx.changes(), store.log)
    changes = triggers.fire(PRE_COMMIT, context)
    tx.rollback()
    tx.put_all(changes)
    written = [changes]

    def before_write(prepared: DataFrame) -> DataFrame:
        prepared = triggers.fire(PRE_PERSIST, replace(context, changes=prepared))
        if rules:
            broken = validate(prepared.filter("op = 'P'"), list(rules)).limit(20).collect()
            if broken:
                raise CancelCommit("; ".join(f"{r['rule']}: {r['key']}" for r in broken))
        written[0] = prepared
        return prepared

    try:
        ts = tx.commit(metadata, before_write)
    except CancelCommit:
        tx.rollback()
        raise
    for timing in (POST_PERSIST, POST_COMMIT):
        triggers.fire(timing, replace(context, changes=written[0]))
    return ts
