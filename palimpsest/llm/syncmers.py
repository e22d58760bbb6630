"""Document fingerprints from closed syncmers, in DataFrame functions only.

The units of a text are short pieces that its characters alone decide on: they end at an a, o or u and
at whatever is no ASCII letter, so a word is a few units and a letter of another script is one. Every text is cut the same way, whatever its length. A window of K units is a
closed syncmer if the least hash among its units is that of its first or its last one. That depends on the
window alone, so an edit elsewhere neither moves nor drops an anchor.

A fingerprint holds the SIZE least anchor hashes of a text, each with the place where it first
stands. Likeness matches two of them by position: of the least hashes of their union, those that
both hold are walked in the order of the one text, and the ones that go on in the other text as well
are counted; their share estimates the common part of the anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Units of a window.
K = 6
#: Up to eleven ASCII letters other than a, o and u, and any character behind them.
UNIT = r"(?s)[b-np-tv-zB-NP-TV-Z]{0,11}."
#: Anchors in a fingerprint, hex digits of each one's hash and place, and what stands between them.
SIZE, DIGITS, BETWEEN = 64, 8, "-"
#: Documents of one bucket, as far as buckets go, when each document is given the next.
WIDTH, BUCKETS = 1000, 1 << 16


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _span(n: Column) -> Column:
    """0 .. n-1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def places(hashes: Column, k: int = K) -> Column:
    """Where the closed syncmers of an array of unit hashes begin.

    Of fewer than ``k`` units, all together are the one anchor; of none there is none.
    """
    def closed(i: Column) -> Column:
        first, *inner, last = [F.get(hashes, i + F.lit(j)) for j in range(k)]
        return F.least(first, last) <= F.least(*inner)

    n = F.size(hashes)
    short = F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(n >= k, F.filter(_span(n - (k - 1)), closed)).otherwise(short)


def anchor_hash(hashes: Column, i: Column, k: int = K) -> Column:
    """Upper 32 bits of the hash of the ``k`` units from place ``i``, or of all if there are fewer."""
    return F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + F.lit(j)) for j in range(k)]), 32)


def unit_hashes(text: Column) -> Column:
    return F.transform(units_of(text), lambda u: F.xxhash64(u))


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n), DIGITS, "0")


def fingerprint(text: Column) -> Column:
    """Hashes of a text's least anchors, ascending, and each one's first place, as hex digits; empty for an empty text."""

    def chosen(at: Column, found: Column) -> Column:
        least = F.slice(F.sort_array(F.array_distinct(found)), 1, SIZE)
        place = lambda x: F.get(at, F.array_position(found, x).cast("int") - 1).cast("long")
        both = lambda u: F.concat_ws(BETWEEN, F.transform(u, _hex), F.transform(u, lambda x: _hex(place(x))))
        return let(least, both)

    def of(hashes: Column) -> Column:
        return let(places(hashes), lambda at: let(F.transform(at, lambda i: anchor_hash(hashes, i)), lambda found: chosen(at, found)))

    return F.when(text == "", F.lit("")).otherwise(let(unit_hashes(text), of))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1; two empty ones are alike, an empty one and another are not."""

    def hashes(parts: Column) -> Column:
        return F.slice(parts, F.lit(1), (F.size(parts) / 2).cast("int"))

    def held(parts: Column, matched: Column) -> Column:
        """The places in one text of hashes that match, in the order of the hashes."""
        half = (F.size(parts) / 2).cast("int")
        return F.filter(F.slice(parts, half + 1, half), lambda _, i: F.array_contains(matched, F.get(parts, i)))

    def share(x: Column, y: Column, least: Column) -> Column:
        def in_order(at: Column) -> Column:
            down = F.filter(at, lambda p, i: F.get(at, i + 1)["b"] < p["b"])
            return (F.size(at) - F.size(down)) / F.size(least)

        def of(matched: Column) -> Column:
            return let(F.sort_array(F.arrays_zip(held(x, matched).alias("a"), held(y, matched).alias("b"))), in_order)

        return let(F.array_intersect(F.array_intersect(least, hashes(x)), hashes(y)), of)

    def of(x: Column, y: Column) -> Column:
        least = F.slice(F.sort_array(F.array_union(hashes(x), hashes(y))), 1, SIZE)
        return F.when(F.arrays_overlap(hashes(x), hashes(y)), let(least, lambda u: share(x, y, u))).otherwise(F.lit(0.0))

    value = let(F.split(a, BETWEEN), lambda x: let(F.split(b, BETWEEN), lambda y: of(x, y)))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(value)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_anchors: bool = False) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` and, if asked for, all anchors with their places.

    One row per input row over its whole text; null text counts as empty, whose fingerprint is
    empty; null ids and repeated rows stay; other columns are ignored; an empty table gives an empty
    result. A text's units are held as one array, so a text may be as long as an array of its units.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    struct = lambda h: lambda i: F.struct(i.alias("pos"), anchor_hash(h, i).alias("hash"))
    more = [let(unit_hashes(F.col("text")), lambda h: F.transform(places(h), struct(h))).alias("anchors")] if with_anchors else []
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"), *more)


def _bucket(place: Column, edges: list[int]) -> Column:
    """How many of the descending ``edges`` are not below ``place``, by binary search."""
    if not edges:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(values, at + step - 1) >= place, step).otherwise(F.lit(0))
    )


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, fingerprint, next_text, next_fingerprint``: by descending id, in a circle.

    Null text counts as empty; null ids come after all others (which must be above -3 * 2**61), by a
    hash of their texts; rows with one id are ordered by text and all lie in one bucket. Buckets are
    ranges of ids between quantiles, of about WIDTH documents each, or, beyond BUCKETS of them, of
    equal numbers. The head of the next bucket is added to each, so no task sees more than one
    bucket at a time, whatever the ids look like, and each text is shuffled once. Other columns are
    ignored; an empty table gives an empty result.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    unnamed = F.shiftrightunsigned(F.xxhash64("text"), 3) + F.lit(-(1 << 63))
    d = d.withColumn("place", F.coalesce("doc_id", unnamed))
    n = min(BUCKETS, -(-d.count() // WIDTH))
    edges: list[int] = []
    if n > 1:
        cuts = F.lit([i / n for i in range(1, n)])
        found = d.agg(F.percentile_approx("place", cuts, 20 * n).alias("edges")).first()["edges"]
        edges = sorted(set(found), reverse=True)
    d = d.withColumn("bucket", _bucket(F.col("place"), edges))
    tops = d.groupBy("bucket").agg(F.max("place").alias("place"))
    # at most one row for each bucket
    heads = d.join(F.broadcast(tops), ["bucket", "place"]).groupBy("bucket", "place")
    heads = materialize(heads.agg(F.min(F.struct("text", "doc_id")).alias("head")))
    circle = Window.orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lead("bucket").over(circle), F.first("bucket").over(circle)).alias("following"))
    extra = heads.select(F.col("bucket").alias("following"), "place", "head.text", "head.doc_id").join(F.broadcast(after), "following")
    extra = extra.select("doc_id", "text", "place", "bucket", F.lit(True).alias("extra"))
    both = d.withColumn("extra", F.lit(False)).unionByName(extra).withColumn("fingerprint", fingerprint(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("extra", F.desc("place"), "text")
    both = both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fingerprint", F.lead("fingerprint").over(w))
    return both.filter(~F.col("extra")).select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
