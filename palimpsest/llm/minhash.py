"""Near-duplicates by min-max hashing of word shingles, with every link confirmed on full sets.

1. Each text becomes the set of its 5-word shingles. Of one permutation both the least and the
   greatest value are kept, so half the hash evaluations give a signature. Texts with equal sets
   are one node from here on; copies are never expanded into pairs.
2. Bands of the signature are buckets. In each bucket every member is held against the bucket's
   least id; links that hold on the full sets contract the graph.
3. Only buckets that still hold more than one component go on. Inside such a bucket, split into
   blocks of bounded size, every pair of different components that the whole signature does not
   rule out is confirmed on full sets; only links come out.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WORDS, materialize, tidy
from .links import components
from .tokens import _two, slices

K = 5
#: A linked pair is in no common bucket with a probability below this.
MISS = 1e-7
#: Members of one bucket that are compared in one task at a time.
BLOCK = 1000
_M = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most selective even rows a band of at most 80 that keep the promise."""
    for rows in (6, 4, 2):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
        if bands <= 80:
            return bands, rows
    return bands, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], k: int = K) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, lower-cased in A-Z."""
    rows = [WORDS.findall(t.translate(ASCII_LOWER)) for t in texts]
    flat = [w for r in rows for w in r]
    if not flat:
        return [np.zeros(0, dtype=np.uint64)] * len(rows)
    codes, words = pd.factorize(np.array(flat, dtype=object))
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)[codes]
    out, at = [], 0
    for r in rows:
        h = hashed[at : at + len(r)]
        at += len(r)
        width = min(k, len(h))
        if not width:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        total = np.full(len(h) - width + 1, np.uint64(width))
        for i in range(width):
            total = _mix(total * _M + h[i : i + len(total)])
        out.append(np.unique(total))
    return out


def signature(shingles: np.ndarray, seeds: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Least and greatest value of the shingles under each permutation, alternating."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max)
    high = np.zeros(len(seeds), dtype=np.uint64)
    for at in range(0, len(shingles), step):
        values = seeds[:, :1] * shingles[None, at : at + step] + seeds[:, 1:]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def seeds_for(values: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 63, (values // 2, 2), dtype=np.uint64)
    seeds[:, 0] |= np.uint64(1)
    return seeds


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    parts = sig.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        key = _mix(key * _M + parts[:, i])
    return key


@lru_cache(1024)
def shingle_set(text: str, k: int = K) -> np.ndarray:
    """The set of one text; a worker meets the same texts in bucket after bucket."""
    return shingle_sets([text], k)[0]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, bands: int, rows: int, k: int = K) -> DataFrame:
    """``doc_id, n_shingles, digest, keys, sig`` of every row; the last three are null without words.

    ``digest`` identifies the shingle set (128 bits), ``keys`` the buckets, and ``sig`` holds a
    byte of each signature value.
    """
    seeds = seeds_for(bands * rows)
    names = ["doc_id", "n_shingles", "digest", "keys", "sig"]

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                out = []
                for s in shingle_sets(texts, k):
                    if len(s):
                        values = signature(s, seeds)
                        keys = band_keys(values, rows).view(np.int64).tolist()
                        short = (_mix(values) & np.uint64(255)).astype(np.uint8).tobytes()
                        out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys, short))
                    else:
                        out.append((0, None, None, None))
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names)

    return _two(docs, "doc_id", "text").mapInArrow(
        tidy(run), "doc_id long, n_shingles long, digest binary, keys array<long>, sig binary"
    )


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, k: int = K) -> DataFrame:
    """The pairs (``a``, ``b``) whose full shingle sets are linked."""
    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            ok = [linked(shingle_set(x, k), shingle_set(y, k), percent) for x, y in zip(ta, tb, strict=True)]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return both.mapInArrow(tidy(run), "a long, b long")


def _links_in_bucket(pdf: pd.DataFrame, bands: int, percent: int, least: float, k: int) -> pd.DataFrame:
    """Links between different components of one bucket or one pair of its blocks.

    A pair is looked at only in the first bucket that both are in. Pairs whose signatures agree in
    less than the share ``least`` are no links. A link makes one component of two, so what comes
    out is a forest.
    """
    pdf = pdf.drop_duplicates("id").sort_values("id")
    n = len(pdf)
    root = {c: c for c in pdf["component"]}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    ids, comp = pdf["id"].to_numpy(), pdf["component"].to_numpy()
    size, side = pdf["n"].to_numpy(), pdf["side"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(n, -1)
    keys = np.stack(pdf["keys"].to_numpy())
    band = int(np.flatnonzero(keys[0] == pdf["key"].iat[0])[0])
    texts = pdf["text"].to_numpy()

    out = []
    two = pdf["pair"].iat[0]
    for i in range(n - 1):
        rest = slice(i + 1, n)
        ok = (100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest])) & (comp[rest] != comp[i])
        if two:
            ok &= side[rest] != side[i]
        places = np.flatnonzero(ok) + i + 1
        if band and len(places):
            places = places[~(keys[places, :band] == keys[i, :band]).any(1)]
        if len(places):
            places = places[(sig[places] == sig[i]).mean(1) >= least]
        for j in places:
            x, y = find(comp[i]), find(comp[j])
            if x != y and linked(shingle_set(texts[i], k), shingle_set(texts[j], k), percent):
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def near_duplicates(
    docs: DataFrame, percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per input row.

    A text's set holds its distinct ``k``-word shingles (its whole word sequence if it has fewer
    words; nothing if it has none), lower-cased in A-Z. Two texts are linked when the sets' common
    part is at least ``percent`` hundredths of their union; ``component_id`` is the least doc_id
    reachable over links, and the row with that id is ``kept``. Texts without words, null ones
    included, are linked with nothing. Rows that share a doc_id are one document here and get the
    same component. A row with a null id is linked with nothing, has a null component and is not
    kept. Other columns are ignored; an empty table gives an empty result.

    A link is confirmed on full sets, so there are no false ones. A linked pair meets in no bucket
    with a probability of at most ``miss``, and then is still one component if any chain of other
    links joins it. Equal sets always meet.
    """
    bands, rows = bands_for(percent / 100, miss)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    all_ = materialize(signatures(docs, bands, rows, k))
    sets = all_.filter("doc_id is not null and digest is not null")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    nodes = materialize(nodes)
    members = nodes.select("id", "n", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last"), F.min(F.struct("id", "n"))["n"].alias("m"))
    buckets = buckets.filter("centre <> last").drop("last")
    near = materialize(members.join(buckets, "key").select("key", "id", "n", "centre", "m"))
    wanted = near.select(F.col("id")).distinct().join(nodes.select("id").distinct(), "id", "left_semi")
    texts = docs.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").filter("text is not null").distinct()
    texts = materialize(texts)
    fits = F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")
    pairs = near.filter((F.col("id") != F.col("centre")) & fits).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialize(confirm(pairs, texts, percent, k))
    first = components(stars)

    # what is left: buckets with more than one component
    label = F.coalesce("component", "id").alias("component")
    left = near.select("key", "id").join(first, "id", "left").select("key", "id", label)
    open_ = left.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size"))
    open_ = open_.filter("x <> y").select("key", "size")
    rest = materialize(left.join(open_, "key"))
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rest = rest.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") <= 2, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("other", other).withColumn("pair", F.col("blocks") > 2)
    rest = rest.withColumn("lo", F.when(F.col("pair"), F.least("side", "other")).otherwise(0))
    rest = rest.withColumn("hi", F.when(F.col("pair"), F.greatest("side", "other")).otherwise(0))
    # inside a block, all pairs; between two blocks, only those across
    rest = rest.withColumn("pair", F.col("lo") != F.col("hi"))
    rest = rest.join(nodes.select("id", "n", "keys", "sig"), "id").join(texts, "id")
    values = bands * rows
    sure = percent / 100
    least = sure - 6 * math.sqrt(sure * (1 - sure) / values)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return _links_in_bucket(pdf, bands, percent, least, k)

    more = rest.select("key", "lo", "hi", "pair", "side", "id", "component", "n", "keys", "sig", "text")
    more = more.groupBy("key", "lo", "hi").applyInPandas(inside, "a long, b long")
    final = components(stars.unionByName(more))

    owner = nodes.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = all_.select("doc_id", "n_shingles", "digest").join(owner, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the row of least id of each component; all columns stay.

    The rules are those of ``near_duplicates``. Rows with a null id are in no component and stay.
    """
    found = near_duplicates(docs, percent, id_col=id_col, text_col=text_col, **kw)
    kept = found.filter("kept").select(F.col("doc_id").alias(id_col)).distinct()
    named = docs.join(kept, id_col, "left_semi").select(*docs.columns)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
