"""Reads of the version log.

The log is a DataFrame ``branch, keyspace, key, ts, op, <payload columns>``; ``op`` is "P" for a put
and "D" for a removal. Whatever is read at (branch, timestamp) comes from the rows that the branch's
ancestry shows, and of each key the nearest branch, then the latest row counts; a removal there hides
what lies behind it, so removals are dropped only after that row is picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.period import FOREVER
from .branches import MASTER, BranchTree, depth, visible

DEFAULT = "default"
PUT, REMOVE = "P", "D"
META = ("branch", "keyspace", "key", "ts", "op")


class VersionLog:
    """A log with its branch tree."""

    def __init__(self, rows: DataFrame, branches: BranchTree | None = None):
        missing = [c for c in META if c not in rows.columns]
        if missing:
            raise ValueError(f"the log lacks the columns {missing}")
        self.rows = rows
        self.branches = branches or BranchTree()
        self.payload = [c for c in rows.columns if c not in META]

    # -- what a read sees ----------------------------------------------------------------------

    def seen(self, branch: str = MASTER, ts: int = FOREVER, since: int | None = None) -> DataFrame:
        """Log rows that (branch, ts) sees, tombstones too, with the ``depth`` of their branch."""
        anc = self.branches.ancestry(branch, ts)
        rows = self.rows.filter(visible(anc, F.col("branch"), F.col("ts")))
        if since is not None:
            rows = rows.filter(F.col("ts") >= since)
        return rows.withColumn("depth", depth(anc, F.col("branch")))

    def snapshot(self, branch: str = MASTER, ts: int = FOREVER, where: Column | None = None, tombstones: bool = False) -> DataFrame:
        """``keyspace, key, ts, branch, <payload>``: of each key the version that is current.

        ``where`` restricts keyspaces or keys and reaches the scan. One aggregation with map-side
        combine; nothing is sorted by time.
        """
        rows = self.seen(branch, ts)
        if where is not None:
            rows = rows.filter(where)
        version = F.struct("op", "ts", "branch", *self.payload)
        latest = rows.groupBy("keyspace", "key").agg(
            F.max_by(version, F.struct(-F.col("depth"), F.col("ts"))).alias("v")
        )
        if not tombstones:
            latest = latest.filter(F.col("v.op") == PUT)
        extra = [F.col("v.op").alias("op")] if tombstones else []
        cols = [F.col(f"v.{c}").alias(c) for c in ("ts", "branch", *self.payload)]
        return latest.select("keyspace", "key", *extra, *cols)

    def get(self, key: str, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """The current version of one key: one row or none."""
        return self.snapshot(branch, ts, (F.col("keyspace") == keyspace) & (F.col("key") == key))

    def get_binary(self, column: str, key: str, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """One payload column of ``get`` as raw bytes: a binary one as it is, another as its text."""
        raw = self.rows.schema[column].dataType.typeName() == "binary"
        value = F.col(column) if raw else F.col(column).cast("string").cast("binary")
        return self.get(key, keyspace, branch, ts).select("key", value.alias("bytes"))

    def exists(self, keys: DataFrame, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, exists`` for each row of ``keys``."""
        live = self.key_set(keyspace, branch, ts).withColumn("there", F.lit(True))
        return keys.select("key").join(live, "key", "left").select("key", F.col("there").isNotNull().alias("exists"))

    def key_set(self, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        return self.snapshot(branch, ts, F.col("keyspace") == keyspace).select("key")

    def keyspaces(self, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``keyspace, since``: keyspaces that (branch, ts) sees, and when each began."""
        return self.seen(branch, ts).groupBy("keyspace").agg(F.min("ts").alias("since"))

    def entries(self, lo: int = 0, hi: int = FOREVER) -> DataFrame:
        """All cells of all branches with ``lo <= ts <= hi``, tombstones too."""
        return self.rows.filter(F.col("ts").between(lo, hi))

    # -- validity ------------------------------------------------------------------------------

    def validity(self, branch: str = MASTER, ts: int = FOREVER, where: Column | None = None) -> DataFrame:
        """``keyspace, key, op, <payload>, valid_from, valid_to``: every version with its period.

        Versions of the branch and its origins form one line per key; a version ends where the next
        begins, an inherited one where the branch writes the key itself.
        """
        rows = self.seen(branch, ts)
        if where is not None:
            rows = rows.filter(where)
        w = Window.partitionBy("keyspace", "key").orderBy("ts", F.desc("depth"))
        end = F.lead("ts", 1, FOREVER).over(w)
        out = rows.withColumn("valid_from", F.col("ts")).withColumn("valid_to", end)
        return out.select("keyspace", "key", "op", *self.payload, "branch", "valid_from", "valid_to")

    def ranged_get(self, keys: DataFrame, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, <payload>, valid_from, valid_to`` at ``ts``, for each row of ``keys``.

        Keys without a value get a period too: before the first version, over a removal, or the
        eternal one if the key never was there. The payload is null then.
        """
        keys = keys.select("key")
        rows = self.seen(branch, FOREVER).filter(F.col("keyspace") == keyspace)
        rows = rows.join(keys.distinct(), "key", "left_semi")
        before = F.col("ts") <= ts
        version = F.when(before, F.struct(F.col("op"), F.col("ts").alias("valid_from"), *self.payload))
        at = rows.groupBy("key").agg(
            F.max_by(version, F.when(before, F.struct(F.col("ts"), -F.col("depth")))).alias("v"),
            F.min(F.when(~before, F.col("ts"))).alias("valid_to"),
        )
        out = keys.join(at, "key", "left")
        live = F.col("v.op") == PUT
        return out.select(
            "key",
            *[F.when(live, F.col(f"v.{c}")).alias(c) for c in self.payload],
            F.coalesce("v.valid_from", F.lit(0)).alias("valid_from"),
            F.coalesce("valid_to", F.lit(FOREVER)).alias("valid_to"),
        )

    def at_coordinates(self, coordinates: DataFrame, branch: str = MASTER) -> DataFrame:
        """As-of join: for each ``keyspace, key, at`` the version valid then; no row where there is none."""
        # versions and coordinates of a key in one line: the last version so far is the one that is valid
        extra = [c for c in coordinates.columns if c not in ("keyspace", "key", "at")]
        asked = coordinates.select("keyspace", "key", F.col("at").alias("__t"), F.lit(None).cast("int").alias("__depth"), F.struct("at", *extra).alias("__asked"))
        rows = self.seen(branch)
        versions = rows.select(
            "keyspace", "key", F.col("ts").alias("__t"), F.col("depth").cast("int").alias("__depth"),
            F.struct("op", F.col("ts").alias("valid_from"), *self.payload).alias("__version"),
        )
        both = versions.unionByName(asked, allowMissingColumns=True)
        line = Window.partitionBy("keyspace", "key")
        up = line.orderBy(F.asc("__t"), F.desc_nulls_last("__depth"))
        down = line.orderBy(F.desc("__t"), F.asc_nulls_first("__depth"))
        both = both.withColumn("__v", F.last("__version", True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
        start = F.when(F.col("__version").isNotNull(), F.col("__t"))
        both = both.withColumn("valid_to", F.last(start, True).over(down.rowsBetween(Window.unboundedPreceding, -1)))
        found = both.filter(F.col("__asked").isNotNull() & (F.col("__v.op") == PUT))
        return found.select(
            "keyspace", "key", "__asked.at", *[F.col(f"__asked.{c}").alias(c) for c in extra], *[F.col(f"__v.{c}").alias(c) for c in self.payload],
            "__v.valid_from", F.coalesce("valid_to", F.lit(FOREVER)).alias("valid_to"),
        )

    # -- history -------------------------------------------------------------------------------

    def history(
        self, key: str, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER, lo: int = 0,
        hi: int = FOREVER, ascending: bool = False,
    ) -> DataFrame:
        """Timestamps at which the key changed, removals included, ``lo`` and ``hi`` included."""
        rows = self.seen(branch, min(ts, hi)).filter((F.col("keyspace") == keyspace) & (F.col("key") == key) & (F.col("ts") >= lo))
        return rows.select("ts").distinct().orderBy(F.asc("ts") if ascending else F.desc("ts"))

    def last_modification(self, keys: DataFrame, keyspace: str = DEFAULT, branch: str = MASTER, ts: int = FOREVER) -> DataFrame:
        """``key, last_modified``: -1 for keys that never changed."""
        rows = self.seen(branch, ts).filter(F.col("keyspace") == keyspace)
        last = rows.groupBy("key").agg(F.max_by("ts", F.struct(-F.col("depth"), F.col("ts"))).alias("m"))
        return keys.select("key").join(last, "key", "left").select("key", F.coalesce("m", F.lit(-1)).alias("last_modified"))

    def modifications(self, lo: int, hi: int, keyspace: str = DEFAULT, branch: str = MASTER) -> DataFrame:
        """``keyspace, key, ts`` of all changes in ``[lo, hi]``."""
        rows = self.seen(branch, hi, since=lo).filter(F.col("keyspace") == keyspace)
        return rows.select("keyspace", "key", "ts").distinct()

    def changed_keys_at(self, ts: int, branch: str = MASTER, keyspace: str | None = None) -> DataFrame:
        """Keys that the commit at ``ts`` changed, on the branch that held it."""
        rows = self.rows.filter((F.col("branch") == self.branches.actual_branch(branch, ts)) & (F.col("ts") == ts))
        if keyspace is not None:
            rows = rows.filter(F.col("keyspace") == keyspace)
        return rows.select("keyspace", "key").distinct()

    # -- statistics and maintenance ------------------------------------------------------------

    def head_statistics(self, branch: str = MASTER) -> DataFrame:
        """``head, total, ratio`` of a branch: live keys, cells of its own, and live keys per cell."""
        own = F.col("branch") == branch
        keys = self.seen(branch).groupBy("keyspace", "key").agg(
            F.max_by("op", F.struct(-F.col("depth"), F.col("ts"))).alias("op"), F.count_if(own).alias("n")
        )
        both = keys.agg(F.count_if(F.col("op") == PUT).alias("head"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        return both.withColumn("ratio", F.when(F.col("total") > 0, F.col("head") / F.col("total")))

    def branch_statistics(self) -> DataFrame:
        """``branch, cells, keys, tombstones, first_ts, last_ts`` of every branch's own rows."""
        return self.rows.groupBy("branch").agg(
            F.count(F.lit(1)).alias("cells"), F.count_distinct("keyspace", "key").alias("keys"),
            F.count_if(F.col("op") == REMOVE).alias("tombstones"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        )

    def rollover(self, ts: int, branch: str = MASTER) -> VersionLog:
        """The log with the head at ``ts`` written anew as puts at ``ts``; reads from then on need no older rows."""
        head = self.snapshot(branch, ts).withColumn("branch", F.lit(branch)).withColumn("ts", F.lit(ts).cast("long"))
        head = head.withColumn("op", F.lit(PUT)).select(*self.rows.columns)
        own = self.rows.join(head.select("branch", "keyspace", "key", "ts"), ["branch", "keyspace", "key", "ts"], "left_anti")
        return VersionLog(own.select(*self.rows.columns).unionByName(head), self.branches)
