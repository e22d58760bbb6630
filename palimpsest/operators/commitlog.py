"""The commit log: ``branch, ts, metadata, internal``; reads stay on one branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.branches import MASTER, BranchTree


class CommitLog:
    def __init__(self, rows: DataFrame, branches: BranchTree | None = None):
        self.rows, self.branches = rows, branches or BranchTree()

    def _own(self, branch: str, internal: bool) -> DataFrame:
        own = self.rows.filter(F.col("branch") == branch)
        return (own if internal else own.filter(~F.col("internal"))).select("ts", "metadata")

    def between(self, lo: int, hi: int, branch: str = MASTER, internal: bool = False, ascending: bool = False) -> DataFrame:
        """Commits in ``[lo, hi]``, latest first; none if ``lo > hi``."""
        return self._own(branch, internal).filter(F.col("ts").between(lo, hi)).orderBy(F.asc("ts") if ascending else F.desc("ts"))

    def paged(
        self, lo: int, hi: int, page_size: int, page: int, branch: str = MASTER, internal: bool = False, ascending: bool = False
    ) -> DataFrame:
        if page_size <= 0 or page < 0:
            raise ValueError("pages have a positive size and count from 0")
        return self.between(lo, hi, branch, internal, ascending).offset(page_size * page).limit(page_size)

    def before(self, ts: int, n: int, branch: str = MASTER, internal: bool = False) -> DataFrame:
        """The ``n`` latest commits before ``ts``, latest first."""
        return self._own(branch, internal).filter(F.col("ts") < ts).orderBy(F.desc("ts")).limit(n)

    def after(self, ts: int, n: int, branch: str = MASTER, internal: bool = False) -> DataFrame:
        """The ``n`` earliest commits after ``ts``; the latest of them first."""
        return self._own(branch, internal).filter(F.col("ts") > ts).orderBy("ts").limit(n).orderBy(F.desc("ts"))

    def around(self, ts: int, n: int, branch: str = MASTER, internal: bool = False) -> DataFrame:
        """Half of ``n`` before ``ts``, the rest at or after it; a short side is filled from the other."""
        own = self._own(branch, internal)
        low = own.filter(F.col("ts") < ts).orderBy(F.desc("ts")).limit(n)
        high = own.filter(F.col("ts") >= ts).orderBy("ts").limit(n)
        # at most n rows on each side from here on
        low = low.withColumn("r", F.row_number().over(Window.orderBy(F.desc("ts")))).withColumn("side", F.lit(0))
        high = high.withColumn("r", F.row_number().over(Window.orderBy("ts"))).withColumn("side", F.lit(1))
        both, all_ = low.unionByName(high), Window.partitionBy()
        lows, highs = F.sum(1 - F.col("side")).over(all_), F.sum("side").over(all_)
        want_low, want_high = n // 2, n - n // 2
        both = both.withColumn("room", F.when(F.col("side") == 0, F.greatest(F.lit(want_low), n - highs)).otherwise(F.greatest(F.lit(want_high), n - lows)))
        return both.filter(F.col("r") <= F.col("room")).select("ts", "metadata").orderBy(F.desc("ts"))

    def count(self, branch: str = MASTER, internal: bool = False) -> DataFrame:
        return self._own(branch, internal).agg(F.count(F.lit(1)).alias("n"))

    def count_between(self, lo: int, hi: int, branch: str = MASTER, internal: bool = False) -> DataFrame:
        """Commits in ``[lo, hi]``, both bounds included."""
        return self.between(lo, hi, branch, internal).agg(F.count(F.lit(1)).alias("n"))

    def metadata_at(self, ts: int, branch: str = MASTER) -> DataFrame:
        """The metadata of the commit at ``ts``; old timestamps are looked up on the origin branch."""
        owner = self.branches.actual_branch(branch, ts)
        return self.rows.filter((F.col("branch") == owner) & (F.col("ts") == ts)).select("ts", "metadata")
