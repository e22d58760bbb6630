"""A store on shared storage: every commit is a Parquet folder that a numbered manifest entry publishes.

Entry n + 1 is created only if it is not there yet, which the file system decides, so of two writers
that saw the same head one succeeds and the other is told that its head is stale. That takes a file system
whose create is exclusive, as HDFS and local ones are; on a plain object store it is a check before a
write, and writers must be kept apart by other means. Readers see the
folders that entries name and nothing else; what a failed writer left behind is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transactions import DO_NOT_MERGE, ON_COMMIT, Store
from ..plans.branches import Branch, BranchTree
from ..plans.versions import VersionLog


class StaleHead(RuntimeError):
    """Another writer has committed since this store was opened or refreshed."""


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; whether it was written."""
    fs, at = _file_system(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001 - the file system's own exception, known by its class only
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


class DurableStore(Store):
    """A ``Store`` whose commits are written to a folder before they are visible."""

    def __init__(self, spark: SparkSession, path: str, entries: list[dict], **options):
        self.path, self.version = path.rstrip("/"), entries[-1]["n"]
        branches = BranchTree([Branch(*b) for b in entries[-1]["branches"]])
        base = max(i for i, e in enumerate(entries) if e.get("base"))
        rows = spark.read.parquet(*[e["rows"] for e in entries[base:]])
        super().__init__(VersionLog(rows, branches), **options)
        self.commits = [(e["branch"], e["ts"], e["metadata"], False) for e in entries if e["ts"] is not None]

    @staticmethod
    def _entries(spark: SparkSession, path: str) -> list[dict]:
        found = [json.loads(r["value"]) for r in spark.read.text(f"{path.rstrip('/')}/manifest/*.json").collect()]
        return sorted(found, key=lambda e: e["n"])

    @classmethod
    def create(cls, log: VersionLog, path: str, **options) -> DurableStore:
        """A new store that begins with the rows of a log."""
        spark, path = log.rows.sparkSession, path.rstrip("/")
        folder = f"{path}/rows/{uuid.uuid4().hex}"
        log.rows.write.parquet(folder)
        entry = {"n": 0, "base": True, "rows": folder, "branch": None, "ts": None, "metadata": None, "branches": _tree(log.branches)}
        if not _create(spark, f"{path}/manifest/{0:012d}.json", json.dumps(entry)):
            raise StaleHead(f"there is a store at {path}")
        return cls.open(spark, path, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, strategy=DO_NOT_MERGE, duplicates: str = ON_COMMIT, **options) -> DurableStore:
        return cls(spark, path, cls._entries(spark, path), strategy=strategy, duplicates=duplicates, **options)

    def write(self, changes: DataFrame, branch: str, metadata: str | None, ts: int | None = None) -> int:
        if self.read_only:
            raise PermissionError("the store is read-only")
        ts = ts or self.next_ts(branch)
        if self.metadata_filter and not self.metadata_filter(branch, ts, metadata):
            raise ValueError("the commit's metadata was rejected")
        rows = changes.withColumn("branch", F.lit(branch)).withColumn("ts", F.lit(ts).cast("long")).select(*self.log.rows.columns)
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        entry = {"rows": folder, "branch": branch, "ts": ts, "metadata": metadata}
        self._publish(entry)
        self.log = VersionLog(self.log.rows.unionByName(self.spark.read.schema(rows.schema).parquet(folder)), self.log.branches)
        self._now[branch] = ts
        self.commits.append((branch, ts, metadata, False))
        return ts

    def _publish(self, entry: dict) -> None:
        n = self.version + 1
        text = json.dumps({"n": n, **entry, "branches": _tree(self.log.branches)})
        if not _create(self.spark, f"{self.path}/manifest/{n:012d}.json", text):
            raise StaleHead(f"commit {n} of {self.path} was made by another writer")
        self.version = n

    def compact(self) -> None:
        """Write all rows anew into one folder, by branch, keyspace and key, which later readers begin with."""
        folder = f"{self.path}/rows/{uuid.uuid4().hex}"
        self.log.rows.repartitionByRange("branch", "keyspace", "key", "ts").sortWithinPartitions("branch", "keyspace", "key", "ts").write.parquet(folder)
        self._publish({"base": True, "rows": folder, "branch": None, "ts": None, "metadata": None})
        self.log = VersionLog(self.spark.read.parquet(folder), self.log.branches)


def _tree(branches: BranchTree) -> list:
    return [[b.name, b.origin, b.branching_ts] for b in branches.all()]
