"""Packing by minimum bin slack.

Each window takes the longest piece left and, by a subset-sum dynamic program over a bitset, the
multiset of remaining lengths that fills it closest to its capacity; the counts are found by going
back through the bitsets. What slack is left is closed by a piece cut off another document. The
last, partly filled sequence of a partition is cut into sequences of power-of-two length, so
nothing is padded.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidy
from .tokens import WordCache, _two, coded_slices, library_fill

CAPACITY = 4096
#: Tokens in a worker's pool that start the filling of windows, and those kept back meanwhile.
POOL_HIGH, POOL_LOW = 3 << 20, 1 << 20
#: Words of one generation of the cache, which holds two.
WORDS_KEPT = 400_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Pool:
    """Pieces left to pack, by length."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.lengths: list[int] = []  # distinct, ascending
        self.total = 0

    def add(self, item) -> None:
        n = len(item[2]) // 4
        if n not in self.by:
            self.by[n] = []
            insort(self.lengths, n)
        self.by[n].append(item)
        self.total += n

    def take(self, n: int):
        items = self.by[n]
        item = items.pop()
        if not items:
            del self.by[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.total -= n
        return item


def best_fill(lengths: list[int], counts, room: int) -> dict[int, int]:
    """Counts by length whose sum is the largest that fits into ``room``.

    ``lengths`` ascend; ``counts(n)`` says how many pieces of that length there are.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in reversed(lengths[: bisect_left(lengths, room + 1)]):
        for _ in range(min(counts(n), room // n)):
            more = (reach | (reach << n)) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for n, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + 1
            at -= n
    return chosen


def fill_window(pool: Pool, capacity: int) -> list:
    """Pieces of one full window; the pool must hold at least ``capacity`` tokens."""
    first = pool.take(pool.lengths[-1])
    window, room = [], capacity
    if len(first[2]) // 4 > room:
        pool.add(first)  # it is cut below
    else:
        window.append(first)
        room -= len(first[2]) // 4
    if window and room and pool.lengths:
        for n, k in best_fill(pool.lengths, lambda n: len(pool.by[n]), room).items():
            window += [pool.take(n) for _ in range(k)]
            room -= n * k
    while room:  # cut what is missing off the longest piece left
        doc, start, ids, total = pool.take(pool.lengths[-1])
        cut = min(room, len(ids) // 4)
        window.append((doc, start, ids[: 4 * cut], total))
        if 4 * cut < len(ids):
            pool.add((doc, start + cut, ids[4 * cut :], total))
        room -= cut
    return window


def windows(pool: Pool, capacity: int, keep: int):
    while pool.total >= max(keep, capacity):
        yield fill_window(pool, capacity)


def powers(pool: Pool):
    """Windows of descending power-of-two lengths that use up a pool of less than a full window."""
    while pool.total:
        yield fill_window(pool, 1 << (pool.total.bit_length() - 1))


def pack(
    docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY,
    id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS_KEPT,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens.

    Rows: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. A document's ids are the tokenizers library's plus ``end_id``. Each id
    is in one piece; the pieces of a sequence lie without gaps from offset 0; every sequence has
    ``capacity`` ids or, at the end of a partition, a power of two. ``capacity`` itself is a power
    of two. Null text counts as empty, so that document is its end id alone. Null ids and repeated
    rows are packed like others; other columns are ignored; an empty table gives no sequences.
    Sequence ids are unique and depend on how the input is partitioned. A worker's cache holds the ids
    of up to twice ``words_kept`` words, which is a matter of memory and speed alone.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        cache, pool, number = WordCache(library_fill(path), words_kept), Pool(), TaskContext.get().partitionId() << 40
        out: list = []

        def rows(sequence):
            nonlocal number
            at = 0
            for doc, start, ids, total in sequence:
                n = len(ids) // 4
                out.append((doc, start, n, ids, total, number, at))
                at += n
            number += 1

        def flush():
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for part in coded_slices(batch):
                known = cache.ready(part.words)
                flat, counts = part.joined([known[w] for w in part.words])
                ends = np.cumsum(counts)
                for doc, lo, hi in zip(part.ids, (ends - counts).tolist(), ends.tolist(), strict=True):
                    blob = flat[lo:hi].tobytes() + end
                    total, full = len(blob) // 4, len(blob) // 4 // capacity * capacity
                    for s in range(0, full, capacity):
                        rows([(doc, s, blob[4 * s : 4 * (s + capacity)], total)])
                    if full < total:
                        pool.add((doc, full, blob[4 * full :], total))
                if pool.total > POOL_HIGH:
                    for w in windows(pool, capacity, POOL_LOW):
                        rows(w)
                if len(out) > 500:
                    yield flush()
        for w in windows(pool, capacity, 0):
            rows(w)
            if len(out) > 5000:
                yield flush()
        for w in powers(pool):
            rows(w)
        if out:
            yield flush()

    return _two(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)
