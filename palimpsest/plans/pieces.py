"""Joins in tasks of bounded size, whatever the size of the input.

Spark's own choice of tasks follows the compressed bytes of a shuffle and the number of cores, so that
the rows of one task grow with the input; and its choice to send a table to all follows the bytes of
files after pruning, of which strings that a query makes are many times as large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input files for a task; bytes up to which a side of a join is surely small.
PIECE, SMALL = 4 << 20, 1 << 20
#: More tasks than that are of no use; estimates beyond that are no estimates.
MOST, UNKNOWN = 20_000, 1 << 50


def _plan(df: DataFrame):
    return df._jdf.queryExecution().optimizedPlan()


def _size(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def _leaves(df: DataFrame) -> tuple[int, int]:
    """The bytes of what is read, and the most partitions of what has no known size, 0 if all has."""
    size = parts = 0
    found = _plan(df).collectLeaves()
    for i in range(found.size()):
        leaf = found.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            parts = max(parts, leaf.rdd().getNumPartitions())
        elif (n := _size(leaf)) < UNKNOWN:
            size += n
        else:
            parts = max(parts, 1)
    return size, parts


def pieces(*tables: DataFrame) -> int:
    """How many tasks share what is made from these tables."""
    found = [_leaves(t) for t in tables]
    return min(MOST, max(1, -(-sum(size for size, _ in found) // PIECE), *[parts for _, parts in found]))


def dealt(df: DataFrame, n: int, *on: str) -> DataFrame:
    """``df`` over ``n`` tasks by a key, if that is more than there are cores for."""
    return df.repartition(n, *on) if n > df.sparkSession.sparkContext.defaultParallelism else df


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` in tasks of bounded size; a large side is not sent to all for a low estimate."""
    keys = [on] if isinstance(on, str) else on

    def small(df: DataFrame) -> bool:
        size, parts = _leaves(df)
        return size <= SMALL and not parts

    if small(right) or (how == "inner" and small(left)):
        return left.join(right, keys, how)
    n = pieces(left, right)
    most = left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    low = any(_size(_plan(df)) <= most for df in ((left, right) if how == "inner" else (right,)))
    left, right = dealt(left, n, *keys), dealt(right, n, *keys)
    return left.join(right.hint("merge") if low else right, keys, how)
