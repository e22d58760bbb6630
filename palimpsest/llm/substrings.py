"""Substring dedup: maximal repeats from prefix-partitioned suffix trees.

The suffixes in the trees begin at anchors: of each window of ``window`` words, the run of K words of
least hash inside it. Equal windows have equal anchors at equal places, and an anchor that occurs once
has no repeat, so only suffixes at anchors that repeat go on; a tree over all suffixes would write
every word ``window`` times. A suffix is a sequence of word codes, to the right as far as its windows
reach, and to the left as well.

Suffixes are dealt to groups by prefixes of varying length: the anchor's K words where at most
LONG_FROM suffixes share them, the whole window where more do, and of a window that is common each
task forwards its first occurrence only. So a group fits into memory whatever passage is common.

Inside a group the suffixes are sorted, and the lengths that neighbours have in common are the depths
of the suffix tree's internal nodes; a second tree holds what stands to the left. Leaves under one node
of depth ``window - o`` whose left parts share ``o`` words have a window in common. Of these, the first
leaf, by document and place, stays; the words under the others go. Neighbouring windows together make
the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import materialize, tidy
from .tokens import byte_slices

WINDOW, K = 20, 6
#: Anchors that occur more often than this get the whole window as prefix, so no group has more suffixes under one anchor.
LONG_FROM = 5000
#: Rows of one key that a task holds before it lets go of those that are settled.
FOLD = 20_000
_M = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` values, by doubling."""
    total, have, part, size = None, 0, h, 1
    while True:
        if n & size:
            if total is None:
                total, have = part, size
            else:  # part covers the first `size` values, total the `have` after them
                total = part[: len(h) - size - have + 1] * np.uint64(pow(_M, have, 1 << 64)) + total[size:]
                have += size
        size *= 2
        if size > n:
            return _mix(total)
        part = part[: len(h) - size + 1] * np.uint64(pow(_M, size // 2, 1 << 64)) + part[size // 2 :]


class Anchored:
    """The windows of some texts and the anchors they hang on."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        flat = [w for row in self.words for w in row]
        self.at = self.row = self.first = self.last = np.zeros(0, dtype=np.int64)
        self.anchor = self.hash = np.zeros(0, dtype=np.uint64)
        self.codes = np.zeros(0, dtype=np.uint32)
        if len(flat) < window:
            return
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)[codes]
        seeds = _run_hashes(h, k)
        begins = np.concatenate([np.arange(s, s + max(0, n - window + 1)) for s, n in zip(self.starts, sizes)])
        if not len(begins):
            return
        span = window - k + 1
        least = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(1)[begins]
        anchors = begins + least
        of_row = np.searchsorted(self.starts, begins, side="right") - 1
        # windows that share an anchor follow each other
        edge = np.flatnonzero(np.r_[True, (anchors[1:] != anchors[:-1]) | (of_row[1:] != of_row[:-1])])
        self.row = of_row[edge]
        base = self.starts[self.row]
        self.at = anchors[edge] - base
        self.anchor = seeds[anchors[edge]]
        self.first = begins[edge] - base
        self.last = begins[np.r_[edge[1:], len(begins)] - 1] - base
        self.hash = _run_hashes(h * np.uint64(_M), window)  # by place in the slice
        self.codes = (h >> np.uint64(32)).astype(np.uint32)


def _batch(columns: dict, schema: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in schema], [n for n, _ in schema])


def _first_of_equals(*columns) -> np.ndarray:
    """For each row the first one with the same values, by the last two columns among them.

    The columns before those say what is equal, the last two are document and place.
    """
    order = np.lexsort(columns[::-1])
    same = columns[:-2]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in same])
    head = np.flatnonzero(new)
    first = np.empty(len(order), dtype=np.int64)
    first[order] = np.repeat(order[head], np.diff(np.r_[head, len(order)]))
    return first


def _common(rows: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows' sequences within their groups, and what each shares with the one before.

    That is the depth of the internal node between two leaves; -1 where a group begins.
    """
    order = np.lexsort((*rows.T[::-1], key))
    rows, sizes, key = rows[order], sizes[order], key[order]
    shared = np.cumprod(rows[1:] == rows[:-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    shared = np.minimum(shared, np.minimum(sizes[1:], sizes[:-1]))
    return order, np.r_[-1, np.where(key[1:] == key[:-1], shared, -1)]


def _nodes(order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """Of each row the node of at least that depth that its leaf is under."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(depth < least)
    return out


def _suffixes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Rows of suffixes under one prefix: ``key, d, tp, words, left``; ``docs`` has ``d, tag, text, places`` and more.

    ``tp`` is the place of the first window and the text's tag, ``words`` the codes from there on, and
    ``left`` how many of them stand before the anchor. A row without words but with marks says which
    of its windows an earlier one of the same task repeats.
    """
    schema = [
        ("key", pa.int64()), ("d", pa.int64()), ("tp", pa.int64()), ("words", pa.binary()), ("left", pa.int32()), ("marks", pa.int32()),
    ]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            d, tags = batch.column("d").to_pylist(), batch.column("tag").to_pylist()
            places = batch.column("places").to_pylist()
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < 1 << 21 and i + 1 < len(texts):
                    continue
                part = slice(at, i + 1)
                at, size = i + 1, 0
                a = Anchored(texts[part], window, k)
                if not len(a.at):
                    continue
                short, long_ = set(), set()
                for r, row in enumerate(places[part]):
                    for p in row:
                        (long_ if p < 0 else short).add((r, p if p >= 0 else ~p))
                row_of, place = a.row.tolist(), a.at.tolist()
                keep = [j for j, x in enumerate(zip(row_of, place)) if x in short]
                dd, tt = np.array(d[part], dtype=np.int64), np.array(tags[part], dtype=np.int64)
                begin = a.starts[a.row] + a.first
                end = a.starts[a.row] + a.last + 1
                if keep:
                    ends = end[keep] + (window - 1)
                    rows = a.row[keep]
                    yield _batch(
                        {
                            "key": a.anchor[keep].view(np.int64), "d": dd[rows], "tp": (a.first[keep] << 32) | tt[rows],
                            "words": [a.codes[b:e].tobytes() for b, e in zip(begin[keep].tolist(), ends.tolist(), strict=True)],
                            "left": (a.at - a.first)[keep].astype(np.int32), "marks": np.zeros(len(keep), dtype=np.int32),
                        },
                        schema,
                    )
                many = [j for j, x in enumerate(zip(row_of, place)) if x in long_]
                if many:
                    n = (end - begin)[many]
                    of = np.repeat(many, n)
                    off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    at_word = begin[of] + off
                    h = a.hash[at_word]
                    key = _mix(a.anchor[of] ^ (h * np.uint64(_M))).view(np.int64)
                    dw, tp = dd[a.row[of]], ((a.first[of] + off) << 32) | tt[a.row[of]]
                    first = _first_of_equals(key, h, dw, tp)
                    whole = np.lib.stride_tricks.sliding_window_view(a.codes, window)
                    later = ((dw != dw[first]) | (tp != tp[first])) & (whole[at_word] == whole[at_word[first]]).all(1)
                    # marks have no group to meet, so they are dealt out by themselves
                    own = _mix(dw.view(np.uint64) * np.uint64(_M) + tp.view(np.uint64)).view(np.int64)
                    # of equal windows of this slice, the first goes on
                    yield _batch(
                        {
                            "key": np.where(later, own, key), "d": dw, "tp": tp,
                            "words": [None if x else a.codes[i : i + window].tobytes() for x, i in zip(later.tolist(), at_word.tolist(), strict=True)],
                            "left": (a.at[of] - a.first[of] - off).astype(np.int32), "marks": later.astype(np.int32),
                        },
                        schema,
                    )

    return docs.mapInArrow(tidy(run), "key long, d long, tp long, words binary, left int, marks int")


def _repeats(key, d, tp, blobs, left, marks, window: int, k: int) -> None:
    """Mark in ``marks`` the windows of some groups of suffixes that repeat an earlier one."""
    real = np.flatnonzero([b is not None for b in blobs])
    if not len(real):
        return
    flat = np.frombuffer(b"".join([blobs[i] for i in real.tolist()]), dtype=np.uint32).astype(np.int64) + 1
    sizes = np.array([len(blobs[i]) // 4 for i in real.tolist()], dtype=np.int64)
    key, d, tp, lefts = key[real], d[real], tp[real], left[real].astype(np.int64)
    rights, begin = sizes - lefts, np.cumsum(sizes) - sizes
    # to the right of the anchor's begin, and to the left of it, nearest first; 0 where there is no word
    place = np.arange(window)
    to_right = np.where(place < rights[:, None], flat[np.minimum(begin[:, None] + lefts[:, None] + place, len(flat) - 1)], 0)
    place = np.arange(window - k)
    to_left = np.where(place < lefts[:, None], flat[np.maximum(begin[:, None] + lefts[:, None] - 1 - place, 0)], 0)
    right_tree, left_tree = _common(to_right, rights, key), _common(to_left, lefts, key)
    for o in range(window - k + 1):
        some = np.flatnonzero((lefts >= o) & (rights >= window - o))
        if len(some) < 2:
            continue
        start = tp[some] + ((lefts[some] - o) << 32)
        first = _first_of_equals(_nodes(*right_tree, window - o)[some], _nodes(*left_tree, o)[some], d[some], start)
        later = (d[some] != d[some][first]) | (start != start[first])
        marks[real[some[later]]] |= (1 << (lefts[some[later]] - o)).astype(np.int32)


def _subtrees(window: int, k: int):
    """Marks of the windows that repeat an earlier one; the rows come sorted by key.

    Where one key has more than FOLD rows, those whose windows are all marked are given out and
    forgotten, for each has an earlier row that stays; so of a window that is everywhere one row stays.
    """

    def run(batches):
        held: list[tuple] = []

        def settle(rows, last: bool):
            key, d, tp = (np.concatenate([r[i] for r in rows]) for i in range(3))
            blobs = [b for r in rows for b in r[3]]
            left, marks = (np.concatenate([r[i] for r in rows]) for i in (4, 5))
            _repeats(key, d, tp, blobs, left, marks, window, k)
            windows = np.array([0 if b is None else len(b) // 4 - window + 1 for b in blobs])
            on = np.ones(len(key), dtype=bool) if last else np.bitwise_count(marks) >= windows
            rest = [i for i, x in enumerate(on.tolist()) if not x]
            kept = [(key[rest], d[rest], tp[rest], [blobs[i] for i in rest], left[rest], marks[rest])] if rest else []
            on &= marks != 0
            done = pa.RecordBatch.from_arrays(
                [pa.array(d[on]), pa.array(tp[on] & 0xFFFFFFFF), pa.array(tp[on] >> 32), pa.array(marks[on])],
                ["d", "tag", "first", "marks"],
            )
            return done, kept

        for batch in batches:
            key, d, tp = (batch.column(i).to_numpy() for i in range(3))
            blobs, left, marks = batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy().copy()
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                yield settle(held, True)[0]
                held = []
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                held.append((key[:cut], d[:cut], tp[:cut], blobs[:cut], left[:cut], marks[:cut]))
                yield settle(held, True)[0]
                held = []
            held.append((key[cut:], d[cut:], tp[cut:], blobs[cut:], left[cut:], marks[cut:]))
            if sum(len(h[0]) for h in held) > FOLD:
                done, held = settle(held, False)
                yield done
        if held:
            yield settle(held, True)[0]

    return run


def substring_dedup(
    docs: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed``: one row per input row.

    The columns named in ``carry`` come along as the struct ``carry``, and with them ``text``.

    Words are runs of anything but ASCII white space. A word goes if a window of ``window`` words
    that covers it also starts earlier: in a document of smaller id, or at an earlier place of the
    same one. Windows are those of the input. ``kept_text`` joins the kept words by one space;
    ``removed`` lists the ranges of word places that went. Null text counts as empty and shorter
    texts than a window lose nothing. A null id comes after all others. Rows that repeat an id and
    text are one document and get the same result; texts that share an id only are told apart, and
    windows at the same place of them are ordered by the texts' checksums. Other columns are
    ignored; an empty table gives an empty result.
    """
    base = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("string").alias("text"),
        *([F.struct(*[docs[c] for c in carry]).alias("carry")] if carry else []),
    )
    base = base.withColumn("d", F.coalesce("doc_id", F.lit(_LAST))).withColumn("tag", F.crc32("text"))

    def anchors_of(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column("d"), batch.column("text")], ["d", "text"])
            tags, done = batch.column("tag").to_numpy(), 0
            for d, blobs in byte_slices(texts):
                a = Anchored(blobs, window, k)
                t, done = tags[done : done + len(d)], done + len(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a.anchor.view(np.int64)), pa.array(np.array(d, dtype=np.int64)[a.row]),
                        pa.array((a.at << 32) | t[a.row]),
                    ],
                    ["seed", "d", "tp"],
                )

    anchors = base.select("d", "tag", "text").mapInArrow(tidy(anchors_of), "seed long, d long, tp long")
    repeated = materialize(anchors.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    place = F.shiftright("tp", 32).cast("int")
    tag = F.col("tp").bitwiseAND(F.lit(0xFFFFFFFF))
    found = anchors.join(repeated, "seed").select(
        "d", tag.alias("tag"), F.when(F.col("n") > LONG_FROM, F.bitwise_not(place)).otherwise(place).alias("place")
    )
    found = found.groupBy("d", "tag").agg(F.collect_set("place").alias("places"))
    # the same columns as in the last join below, so that one exchange of the texts serves both
    again = base.join(found, ["d", "tag"])
    suffixes = _suffixes(again, window, k).repartition("key").sortWithinPartitions("key")
    marks = suffixes.mapInArrow(tidy(_subtrees(window, k)), "d long, tag long, first long, marks int")
    marks = marks.groupBy("d", "tag").agg(F.collect_list(F.struct("first", "marks")).alias("marks"))
    more = ["carry"] if carry else []
    marked = base.join(marks, ["d", "tag"], "left").select("doc_id", "text", "marks", *more)
    more += ["text"] if carry else []

    def apply(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            out = []
            for text, rows in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for r in rows or ():
                    for bit in range(r["marks"].bit_length()):
                        if r["marks"] >> bit & 1:
                            gone[r["first"] + bit] += 1
                            gone[r["first"] + bit + window] -= 1
                lost = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, lost, False].astype(np.int8)))
                spans = [{"begin": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
                kept, at = [], 0
                for s in spans:
                    kept += words[at : s["begin"]]
                    at = s["end"]
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
            n, m, t, s = zip(*out, strict=True) if out else ((), (), (), ())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(t, pa.string()), pa.array(s, kind), *batch.columns[3:], *([batch.column(1)] if carry else [])],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed", *more],
            )

    span = StructType([StructField("begin", LongType()), StructField("end", LongType())])
    fields = [StructField(c, LongType()) for c in ("doc_id", "n_words", "n_removed")]
    fields += [StructField("kept_text", StringType()), StructField("removed", ArrayType(span))]
    return marked.mapInArrow(tidy(apply), StructType(fields + [marked.schema[c] for c in more]))


def drop_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each text brought down to its kept words; other columns stay as they are.

    Rows of which every word goes are left out; rows without words stay as they are.
    """
    rest = tuple(c for c in docs.columns if c != text_col) or (id_col,)
    done = substring_dedup(docs, window, id_col=id_col, text_col=text_col, carry=rest)
    done = done.filter("n_removed < n_words or n_words = 0")
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias(text_col)
    return done.select(*[changed if c == text_col else F.col("carry")[c].alias(c) for c in docs.columns])
