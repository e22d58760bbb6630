"""The log as a stream: commits arrive as files and are appended; heads are kept up to date.

The log is independent of order, so late rows need no special care there: a read at a timestamp counts
them as soon as they are there. Counts by window that are emitted once need a bound for late rows, and
``commits_per_window`` has one; ``all_commits_per_window`` has none and keeps every window open instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_changes(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of log rows from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_log(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a log by branch and keyspace, exactly once."""
    return (
        changes.writeStream.format("parquet").partitionBy("branch", "keyspace").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def heads(changes: DataFrame, payload: list[str]) -> DataFrame:
    """The running head of each branch's own keys: the latest row of each, for update or complete mode."""
    row = F.struct("ts", "op", *payload)
    latest = changes.groupBy("branch", "keyspace", "key").agg(F.max_by(row, "ts").alias("v"))
    return latest.select("branch", "keyspace", "key", *[F.col(f"v.{c}").alias(c) for c in ("ts", "op", *payload)])


def commits_per_window(changes: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Changes by branch and time window; rows later than ``late`` behind the newest are left out."""
    at = changes.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    counted = at.groupBy("branch", F.window("at", length)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("branch", F.unix_millis("window.start").alias("window_start"), "n")


def all_commits_per_window(changes: DataFrame, length: str = "1 hour") -> DataFrame:
    """Changes by branch and time window, however late they are: for update or complete mode, without a watermark."""
    at = changes.withColumn("at", F.timestamp_millis("ts"))
    counted = at.groupBy("branch", F.window("at", length)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("branch", F.unix_millis("window.start").alias("window_start"), "n")
