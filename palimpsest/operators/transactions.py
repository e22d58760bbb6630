"""Change sets, duplicate elimination, conflicts, commits."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.branches import MASTER
from ..plans.versions import DEFAULT, PUT, REMOVE, VersionLog

OVERWRITE_WITH_SOURCE, OVERWRITE_WITH_TARGET, DO_NOT_MERGE = "source", "target", "fail"
ON_COMMIT, DISABLED = "on_commit", "disabled"


class CommitConflict(RuntimeError):
    """Another transaction changed the same keys and the strategy does not merge."""


def last_per_key(changes: DataFrame) -> DataFrame:
    """Of changes ``keyspace, key, op, <payload>, seq`` the last of each key."""
    rest = [c for c in changes.columns if c not in ("keyspace", "key", "seq")]
    picked = changes.groupBy("keyspace", "key").agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return picked.select("keyspace", "key", *[F.col(f"v.{c}").alias(c) for c in rest])


def same_value(payload: list[str], a: str, b: str) -> Column:
    return F.struct(*[F.col(f"{a}.{c}") for c in payload]).eqNullSafe(F.struct(*[F.col(f"{b}.{c}") for c in payload]))


def eliminate_duplicates(changes: DataFrame, log: VersionLog, branch: str = MASTER, ts: int = (1 << 63) - 1) -> DataFrame:
    """Changes that change something: puts of a new value, and removals of a key that is there."""
    old = log.snapshot(branch, ts).select("keyspace", "key", F.struct(*log.payload).alias("old"))
    both = changes.withColumn("new", F.struct(*log.payload)).join(old, ["keyspace", "key"], "left")
    put, there = F.col("op") == PUT, F.col("old").isNotNull()
    keep = F.when(put, ~(there & same_value(log.payload, "new", "old"))).otherwise(there)
    return both.filter(keep).select(*changes.columns)


def drop_repeated_versions(log: VersionLog) -> DataFrame:
    """The log without rows that repeat the version before them on the same branch."""
    from pyspark.sql import Window

    w = Window.partitionBy("branch", "keyspace", "key").orderBy("ts")
    value = F.struct("op", *log.payload)
    rows = log.rows.withColumn("now", value).withColumn("before", F.lag(value).over(w))
    repeated = F.col("before").isNotNull() & F.col("now").eqNullSafe(F.col("before"))
    return rows.filter(~repeated).drop("now", "before")


def conflicts(changes: DataFrame, log: VersionLog, branch: str, tx_ts: int) -> DataFrame:
    """``keyspace, key, source, target, ancestor, target_ts`` of changes whose key moved on since ``tx_ts``.

    The sides are structs of ``op`` and payload; ``ancestor`` is null where the key had no value.
    """
    side = F.struct("op", *log.payload)
    head = log.snapshot(branch, tombstones=True).filter(F.col("ts") > tx_ts)
    head = head.select("keyspace", "key", side.alias("target"), F.col("ts").alias("target_ts"))
    old = log.snapshot(branch, tx_ts).withColumn("op", F.lit(PUT)).select("keyspace", "key", side.alias("ancestor"))
    mine = changes.select("keyspace", "key", side.alias("source"))
    return mine.join(head, ["keyspace", "key"]).join(old, ["keyspace", "key"], "left").select(
        "keyspace", "key", "source", "target", "ancestor", "target_ts"
    )


def resolve(
    changes: DataFrame, log: VersionLog, branch: str, tx_ts: int, strategy: str | Callable[[Column, Column, Column], Column]
) -> DataFrame:
    """The changes to write once conflicts are resolved.

    ``strategy`` is one of the constants or a function of (source, target, ancestor) columns that
    gives the struct to write. What equals the target is not written again. DO_NOT_MERGE raises.
    """
    found = conflicts(changes, log, branch, tx_ts)
    if strategy == DO_NOT_MERGE:
        if not found.isEmpty():
            raise CommitConflict("keys were changed by another transaction")
        return changes
    pick = {
        OVERWRITE_WITH_SOURCE: lambda s, t, a: s,
        OVERWRITE_WITH_TARGET: lambda s, t, a: t,
    }.get(strategy, strategy)
    merged = found.withColumn("result", pick(F.col("source"), F.col("target"), F.col("ancestor")))
    write = merged.filter(~F.col("result").eqNullSafe(F.col("target")))
    write = write.select("keyspace", "key", *[F.col(f"result.{c}").alias(c) for c in ("op", *log.payload)])
    free = changes.join(found.select("keyspace", "key"), ["keyspace", "key"], "left_anti")
    return free.select("keyspace", "key", "op", *log.payload).unionByName(write)


def merge_maps(source: Column, target: Column, ancestor: Column, source_wins: bool) -> Column:
    """Three-way merge of property maps: what one side changed is taken, of what both changed the winner's."""
    keys = F.array_distinct(F.concat(F.map_keys(source), F.map_keys(target), F.map_keys(ancestor)))

    def value(k: Column) -> Column:
        s, t, a = (F.element_at(m, k) for m in (source, target, ancestor))
        mine, theirs = ~s.eqNullSafe(a), ~t.eqNullSafe(a)
        return F.when(mine & theirs, s if source_wins else t).when(mine, s).otherwise(t)

    pairs = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))), lambda p: p["value"].isNotNull())
    return F.map_from_entries(pairs)


def property_status(before: Column, after: Column) -> Column:
    """Map of property name to NEW, REMOVED, MODIFIED or PERSISTED."""
    keys = F.array_distinct(F.concat(F.map_keys(before), F.map_keys(after)))

    def status(k: Column) -> Column:
        b, a = F.element_at(before, k), F.element_at(after, k)
        return F.when(b.isNull(), "NEW").when(a.isNull(), "REMOVED").when(b != a, "MODIFIED").otherwise("PERSISTED")

    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, status(k))))


class Transaction:
    """Changes against one (branch, timestamp). Reads see the snapshot only, never own changes."""

    def __init__(self, store: Store, branch: str = MASTER, ts: int | None = None):
        self.store, self.branch = store, branch
        self.ts = store.now(branch) if ts is None else ts
        self._rows: list[tuple] = []
        self._frames: list[DataFrame] = []
        self._staged: DataFrame | None = None
        self._incremental_ts: int | None = None

    def get(self, key: str, keyspace: str = DEFAULT) -> DataFrame:
        return self.store.log.get(key, keyspace, self.branch, self.ts)

    def key_set(self, keyspace: str = DEFAULT) -> DataFrame:
        return self.store.log.key_set(keyspace, self.branch, self.ts)

    def put(self, key: str, value: tuple | None, keyspace: str = DEFAULT) -> None:
        if value is None:
            raise ValueError("null is no value; use remove")
        self._rows.append((keyspace, key, PUT, *value))

    def remove(self, key: str, keyspace: str = DEFAULT) -> None:
        self._rows.append((keyspace, key, REMOVE, *[None] * len(self.store.log.payload)))

    def put_all(self, rows: DataFrame) -> None:
        """Changes from a DataFrame of ``keyspace, key, op, <payload>``, a key once at most."""
        self._frames.append(rows.select("keyspace", "key", "op", *self.store.log.payload))

    def changes(self) -> DataFrame:
        log = self.store.log
        fields = [log.rows.schema[c] for c in ("keyspace", "key", "op", *log.payload)]
        seq = [(*r, i) for i, r in enumerate(self._rows)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", seq long"
        own = self.store.spark.createDataFrame(seq, schema)
        for f in self._frames:
            own = own.unionByName(f.withColumn("seq", F.lit(-1).cast("long")))
        return last_per_key(own)

    def rollback(self) -> None:
        self._rows, self._frames, self._staged, self._incremental_ts = [], [], None, None

    def commit_incremental(self) -> int:
        """Stage the changes so far under one timestamp; they show after the final commit only."""
        if self._incremental_ts is None:
            self._incremental_ts = self.store.next_ts(self.branch)
        part = self.changes()
        if self._staged is not None:
            part = self._staged.join(part.select("keyspace", "key"), ["keyspace", "key"], "left_anti").unionByName(part)
        self._staged = part
        self._rows, self._frames = [], []
        return self._incremental_ts

    def prepare(self) -> tuple[DataFrame, int | None]:
        """What a commit would write: without duplicates, merged with what others wrote meanwhile."""
        if self._incremental_ts is not None:
            ts = self.commit_incremental()
            return self._staged, ts
        changes = self.changes()
        if self.store.duplicates == ON_COMMIT:
            changes = eliminate_duplicates(changes, self.store.log, self.branch, self.ts)
        return resolve(changes, self.store.log, self.branch, self.ts, self.store.strategy), None

    def commit(self, metadata: str | None = None, before_write: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Write the changes under one new timestamp and return it; -1 if nothing changes.

        ``before_write`` sees what is about to be written and gives what is written instead.
        """
        if self._incremental_ts is None and not self._rows and not self._frames:
            return -1
        changes, ts = self.prepare()
        if before_write is not None:
            changes = before_write(changes)
        if ts is None and changes.isEmpty():
            self.rollback()
            return -1
        done = self.store.write(changes, self.branch, metadata, ts)
        self.rollback()
        return done


class Store:
    """A version log that transactions write to, with a commit log beside it.

    It lives as long as the session does: commits are unions of plans. ``cached`` keeps the log's
    rows in executor memory, and on their disks what does not fit.
    """

    def __init__(
        self, log: VersionLog, strategy=DO_NOT_MERGE, duplicates: str = ON_COMMIT, read_only: bool = False,
        metadata_filter: Callable[[str, int, str | None], bool] | None = None,
    ):
        self.log, self.strategy, self.duplicates, self.read_only = log, strategy, duplicates, read_only
        self.metadata_filter = metadata_filter
        self.spark: SparkSession = log.rows.sparkSession
        self.commits: list[tuple[str, int, str | None, bool]] = []
        self._now: dict[str, int] = {}

    def now(self, branch: str) -> int:
        """The latest commit timestamp of the branch."""
        if branch not in self._now:
            last = self.log.rows.filter(F.col("branch") == branch).agg(F.max("ts")).first()[0]
            self._now[branch] = max(last or 0, self.log.branches.get(branch).branching_ts)
        return self._now[branch]

    def next_ts(self, branch: str) -> int:
        """A millisecond later than any commit of the branch."""
        return max(int(time.time() * 1000), self.now(branch) + 1)

    def cached(self) -> Store:
        self.log = VersionLog(self.log.rows.persist(), self.log.branches)
        return self

    def tx(self, branch: str = MASTER, ts: int | None = None) -> Transaction:
        return Transaction(self, branch, ts)

    def write(self, changes: DataFrame, branch: str, metadata: str | None, ts: int | None = None) -> int:
        if self.read_only:
            raise PermissionError("the store is read-only")
        ts = ts or self.next_ts(branch)
        if self.metadata_filter and not self.metadata_filter(branch, ts, metadata):
            raise ValueError("the commit's metadata was rejected")
        rows = changes.withColumn("branch", F.lit(branch)).withColumn("ts", F.lit(ts).cast("long"))
        self.log = VersionLog(self.log.rows.unionByName(rows.select(*self.log.rows.columns)), self.log.branches)
        self._now[branch] = ts
        self.commits.append((branch, ts, metadata, False))
        return ts

    def commit_log(self) -> DataFrame:
        return self.spark.createDataFrame(self.commits, "branch string, ts long, metadata string, internal boolean")
