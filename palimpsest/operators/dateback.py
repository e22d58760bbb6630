"""Corrections of history: purge, inject and transform, each giving a new log."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.branches import MASTER
from ..plans.versions import DEFAULT, VersionLog


@dataclass
class Dateback:
    """Operations on one branch's own rows. ``audit`` lists what was done.

    Reads during a dateback are limited to what lies before the earliest touched timestamp. Each
    operation marks all indices of ``indices`` dirty, for what was derived from the log is stale.
    """

    log: VersionLog
    branch: str = MASTER
    audit: list[tuple[str, str, int, int, int]] = field(default_factory=list)
    indices: object = None

    def _own(self) -> Column:
        return F.col("branch") == self.branch

    def _done(self, kind: str, rows: DataFrame, lo: int, hi: int) -> VersionLog:
        self.audit.append((kind, self.branch, lo, hi, int(time.time() * 1000)))
        self.log = VersionLog(rows.select(*self.log.rows.columns), self.log.branches)
        if self.indices is not None:
            self.indices.log = self.log
            self.indices.mark_all_dirty()
        return self.log

    @property
    def untouched_until(self) -> int:
        """The latest timestamp that no operation has touched."""
        return min((lo for _, _, lo, _, _ in self.audit), default=1 << 62) - 1

    def snapshot(self, ts: int) -> DataFrame:
        return self.log.snapshot(self.branch, min(ts, self.untouched_until))

    def _purge(self, kind: str, what: Column, lo: int, hi: int) -> VersionLog:
        return self._done(kind, self.log.rows.filter(~(self._own() & what)), lo, hi)

    def purge_entry(self, key: str, ts: int, keyspace: str = DEFAULT) -> VersionLog:
        return self._purge("purge_entry", _at(keyspace, key) & (F.col("ts") == ts), ts, ts)

    def purge_key(
        self, key: str, keyspace: str = DEFAULT, lo: int = 0, hi: int = (1 << 63) - 1, where: Column | None = None
    ) -> VersionLog:
        what = _at(keyspace, key) & F.col("ts").between(lo, hi)
        return self._purge("purge_key", what if where is None else what & where, lo, hi)

    def purge_keyspace(self, keyspace: str, lo: int = 0, hi: int = (1 << 63) - 1) -> VersionLog:
        return self._purge("purge_keyspace", (F.col("keyspace") == keyspace) & F.col("ts").between(lo, hi), lo, hi)

    def purge_commits(self, lo: int, hi: int | None = None) -> VersionLog:
        hi = lo if hi is None else hi
        return self._purge("purge_commits", F.col("ts").between(lo, hi), lo, hi)

    def inject(self, entries: DataFrame, override: bool = False) -> VersionLog:
        """Add cells ``keyspace, key, ts, op, <payload>``; one that is there stays unless overridden."""
        new = entries.withColumn("branch", F.lit(self.branch)).select(*self.log.rows.columns)
        on = ["branch", "keyspace", "key", "ts"]
        old = self.log.rows
        if override:
            rows = old.join(new.select(*on), on, "left_anti").select(*old.columns).unionByName(new)
        else:
            rows = old.unionByName(new.join(old.select(*on), on, "left_anti").select(*old.columns))
        span = entries.agg(F.min("ts"), F.max("ts")).first()
        return self._done("inject", rows, span[0] or 0, span[1] or 0)

    def _transform(self, kind: str, what: Column, change: Callable[[str, Column], Column], lo: int, hi: int) -> VersionLog:
        """``change(name, column)`` gives the new payload column; it may return the column unchanged."""
        on = self._own() & what & (F.col("op") == "P")
        rows = self.log.rows.withColumns({c: F.when(on, change(c, F.col(c))).otherwise(F.col(c)) for c in self.log.payload})
        return self._done(kind, rows, lo, hi)

    def transform_entry(self, key: str, ts: int, change, keyspace: str = DEFAULT) -> VersionLog:
        return self._transform("transform_entry", _at(keyspace, key) & (F.col("ts") == ts), change, ts, ts)

    def transform_values_of_key(self, key: str, change, keyspace: str = DEFAULT) -> VersionLog:
        return self._transform("transform_values_of_key", _at(keyspace, key), change, 0, (1 << 63) - 1)

    def transform_commit(self, ts: int, change) -> VersionLog:
        return self._transform("transform_commit", F.col("ts") == ts, change, ts, ts)

    def transform_values_of_keyspace(self, keyspace: str, change) -> VersionLog:
        return self._transform("transform_values_of_keyspace", F.col("keyspace") == keyspace, change, 0, (1 << 63) - 1)

    def update_commit_metadata(self, commits: DataFrame, ts: int, metadata: str | None) -> DataFrame:
        on = self._own() & (F.col("ts") == ts)
        self.audit.append(("update_commit_metadata", self.branch, ts, ts, int(time.time() * 1000)))
        return commits.withColumn("metadata", F.when(on, F.lit(metadata)).otherwise(F.col("metadata")))

    def operations(self, affecting: int | None = None, since: int = 0, until: int = 1 << 62, branch: str | None = None) -> list[tuple]:
        """The audit log: by wall-clock range, and only what affects a timestamp of a branch if given.

        An operation on an origin affects a branch as far as the branch still sees the origin there.
        """
        rows = [r for r in self.audit if since <= r[4] <= until]
        if affecting is None:
            return rows
        seen = {a.branch: a.hi for a in self.log.branches.ancestry(branch or self.branch, affecting)}
        return [r for r in rows if r[1] in seen and r[2] <= seen[r[1]]]

    def audit_log(self) -> DataFrame:
        """The audit log as a table, to be written beside the store: ``operation, branch, lo, hi, wall_clock``."""
        spark = self.log.rows.sparkSession
        return spark.createDataFrame(self.audit, "operation string, branch string, lo long, hi long, wall_clock long")


def _at(keyspace: str, key: str) -> Column:
    return (F.col("keyspace") == keyspace) & (F.col("key") == key)
