"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row.

Only DataFrame functions run here, in three steps. Rows are counted by their hash alone, so what is
shuffled is a hash and an id, and map-side aggregation leaves one row per hash and task. Only the
texts whose hash is there more than once are then grouped by (hash, text), so Spark compares the full
bytes of texts that share a hash, and a collision never merges two of them. Last, the rows are held
against those groups, which are broadcast if they are few and joined by hash if they are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Groups, of about 100 bytes each, up to which they are sent to all executors.
FEW = 200_000


def content_hash(text: Column) -> Column:
    """128-bit hash of the text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _sized(df: DataFrame) -> DataFrame:
    """``df``, which is written already, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, normalize, hash_fn) -> tuple[DataFrame, bool]:
    """The rows as ``row, id, norm`` with ``keep_id, group_size, winners``, which are null where the text is there once.

    ``winners`` is how many rows of the text have the id that stays. Beside them, whether any has
    more than one such row.
    """
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"),
        normalize(F.coalesce(docs[text_col], F.lit(""))).alias("norm"),
    ).withColumn("h", hash_fn(F.col("norm")))
    again = materialize(base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    several = base.select("id", "norm", "h").join(_sized(again.select("h")), "h", "left_semi")
    by_id = several.groupBy("h", "norm", "id").agg(F.count(F.lit(1)).alias("n"))
    # a null id comes last either way
    best = {
        "min": F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")),
        "max": F.max(F.struct(F.col("id").isNotNull().alias("first"), "id", "n")),
    }[keep]
    groups = by_id.groupBy("h", "norm").agg(best.alias("best"), F.sum("n").alias("group_size"))
    groups = groups.select(
        "h", _digest(F.col("norm")).alias("digest"), F.col("best.id").alias("keep_id"), "group_size", F.col("best.n").alias("winners")
    )
    groups = materialize(groups.filter("group_size > 1"))
    told = groups.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("hashes"), F.sum("group_size").alias("rows"), F.max("winners").alias("winners")).first()
    keys = ["h"]
    # with another text under the same hash, or one that is there once, the hash does not tell them apart
    if told["n"] != told["hashes"] or told["rows"] != again.agg(F.sum("n")).first()[0]:
        base, keys = base.withColumn("digest", _digest(F.col("norm"))), ["h", "digest"]
    else:
        groups = groups.drop("digest")
    return base.join(F.broadcast(groups) if told["n"] <= FEW else groups, keys, "left"), (told["winners"] or 0) > 1


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
    normalize=ascii_lower, hash_fn=content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when ``normalize`` makes them identical. ``keep`` ("min" or "max") picks the
    id of the group that stays. Null text counts as empty. A null id stays only if no row of the
    text has another; then ``keep_id`` is null. Rows that repeat an id and text all count in
    ``group_size`` and are all ``kept`` or all dropped. An empty table gives an empty result. Other
    columns of the input are ignored, whatever their names. Texts may be as long as a column allows.
    """
    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    joined, _ = _grouped(two, "doc_id", "text", keep, normalize, hash_fn)
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.sha2("norm", 256).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
    normalize=ascii_lower, hash_fn=content_hash,
) -> DataFrame:
    """``docs`` with one row of each text, all columns kept, whatever their names.

    The rules are those of ``exact_dedup``; of rows that repeat both id and text, or that have the
    text and a null id where no row has another, one is left. An empty table gives an empty result.
    """
    joined, repeats = _grouped(docs, id_col, text_col, keep, normalize, hash_fn)
    once = F.col("group_size").isNull()
    stays = once | F.col("id").eqNullSafe(F.col("keep_id"))
    if not repeats:
        return joined.filter(stays).select("row.*")
    alone = joined.filter(stays & (once | (F.col("winners") == 1)))
    several = joined.filter(stays & (F.col("winners") > 1)).dropDuplicates(["h", "norm", "id"])
    return alone.select("row.*").unionByName(several.select("row.*"))
