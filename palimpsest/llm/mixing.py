"""Language-model scores by online logistic context mixing.

A text is a sequence of words and an end mark, and each of them is a sequence of bits:

* Does the word stand somewhere in the training texts after the two words before it? If so, it is
  picked among the words that do, by their counts, and done. If not, the same is asked of the one
  word before it.
* What neither names is coded by the bits of its class, by how it begins, and then
  picked inside its class by the words' counts, where a class has one place for all unknown words.

So the whole word is what is predicted, and what predicts it are exact counts of runs of one, two and
three words over all training texts, under hashes that lengthen with the corpus; they are as many as
the corpus has. Each bit has several predictors, which are hashed contexts with the numbers of 0 and 1
seen in them: how often the words before were seen, how long the run of foreseen words is, classes and
letters of the words before. Their logits are added up with weights that a gate picks by the kind and
place of the bit and by what is known of the context. The weights are learnt from all training texts,
in passes that sum up slopes over them; every text starts from the same ones and adds its own, refined
as the text goes on. A score is a function of the tables alone, however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .tokens import ascii_words

ADD = 0.1
#: Bits of a class, and the classes.
BITS = 6
CLASSES = 1 << BITS
#: Runs of up to this many words are counted.
ORDERS = 3
#: Passes over all training texts that the shared weights are learnt in.
PASSES = 2
#: Tokens of one block, of the part of it that is scored at once, and between two refinements.
BLOCK, PART, CHUNK = 1_000_000, 50_000, 128
#: Characters of text that are split into words at once.
SLICE = 1 << 20
#: Keys of one range of hashes, and bits of a hash beyond those that number the corpus's tokens: of a
#: word's, which base_score counts, and of a run's, where one run in four thousand may pass for another.
RANGE_KEYS, WORD_SPARE, RUN_SPARE = 1 << 21, 32, 12
#: A context seen this often is well known, for the gate.
KNOWN = 16
#: Slots of the contexts of each place: of the two questions for what is foreseen, then of the class's bits.
ASKED = (256, CLASSES * 32, 1024)
CODED = (CLASSES, CLASSES << BITS, CLASSES << (2 * BITS), CLASSES << (BITS + 5))
PLACES = 2 + BITS
INPUTS = 5
#: Pieces that the tables are added up in.
PIECES = 16

BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, sizes array<int>, bytes array<long>, train array<boolean>, tokens binary,"
    " hashes binary, classes binary, tails binary"
)
COUNTED_SCHEMA = (
    "doc_ids array<long>, sizes array<int>, bytes array<long>, train array<boolean>, tokens binary, classes binary,"
    " tails binary, one binary, two binary, three binary"
)
_M = np.uint64(0x9E3779B97F4A7C15)


def class_of(word: bytes) -> int:
    """A part of the vocabulary, by the begin of the word; which word of it is told by what is picked."""
    return xxhash.xxh32_intdigest(word[:2]) % (CLASSES - 1) + 1 if word else 0


def _pack(values: np.ndarray) -> bytes:
    """Compressed, byte by byte of all values."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _record(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()),
    }
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _hash_bytes(hashes: np.ndarray) -> bytes:
    """The upper six bytes of each hash where they tell all words of a block apart, else all eight."""
    width = 6 if len(np.unique(hashes >> np.uint64(16))) == len(hashes) else 8
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _hashes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    width = len(raw) // n
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(n, width)
    return out.view(">u8").ravel().astype(np.uint64)


def _slices(lengths: np.ndarray):
    """Ranges of rows of about SLICE characters."""
    at = total = 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= SLICE or i == len(lengths) - 1:
            yield at, i + 1
            at, total = i + 1, 0


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents as token numbers, with hash, class and last letter of the block's words.

    ``docs`` has ``doc_id, text, train``. Words are lower-cased in A-Z; each text ends with an end
    mark, which is word number 0.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, sizes, lengths, words, total = [], [], [], [], [], 0

        def flush():
            nonlocal number
            coded = pa.concat_arrays(words).dictionary_encode()
            distinct = [b"", *coded.dictionary.cast(pa.binary()).to_pylist()]
            n = np.concatenate(sizes)
            tokens = np.zeros(n.sum(), dtype=np.int32)
            inner = np.ones(len(tokens), dtype=bool)
            inner[np.cumsum(n) - 1] = False
            tokens[inner] = coded.indices.to_numpy() + 1
            row = [
                [number], [ids], [n.tolist()], [np.concatenate(lengths).tolist()], [train], [_pack(tokens)],
                [_hash_bytes(np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64))],
                [_pack(np.array([class_of(w) for w in distinct], dtype=np.uint8))],
                [_pack(np.array([w[-1] & 31 if w else 0 for w in distinct], dtype=np.uint8))],
            ]
            number += 1
            return _record(row, BLOCK_SCHEMA)

        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _slices(n_bytes):
                found, counts = ascii_words(pc.ascii_lower(texts.slice(a, b - a)))
                words.append(found)
                sizes.append(counts + 1)
                lengths.append(n_bytes[a:b])
                ids += batch.column(0).slice(a, b - a).to_pylist()
                train += batch.column(2).slice(a, b - a).to_pylist()
                total += len(found) + b - a
                if total >= BLOCK:
                    yield flush()
                    ids, train, sizes, lengths, words, total = [], [], [], [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", "train").mapInArrow(tidy(run), BLOCK_SCHEMA)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _before(values: np.ndarray, starts: np.ndarray, n: int, first=0) -> np.ndarray:
    """The value ``n`` places before, and ``first`` at the begin of a document."""
    out = np.full_like(values, first)
    out[n:] = values[:-n]
    for k in range(n):
        at = starts + k
        out[at[at < len(out)]] = first
    return out


def run_keys(words: np.ndarray, tokens: np.ndarray, starts: np.ndarray, bits: tuple[int, int]) -> list[np.ndarray]:
    """Keys of ``bits`` bits: of each word of the block, and of the runs of two and three that end with each token.

    Runs go by the upper six bytes of their words' hashes.
    """
    keep = np.uint64(64 - bits[1])
    hashes = (words >> np.uint64(16))[tokens]
    one, two = _before(hashes, starts, 1), _before(hashes, starts, 2)
    pair = _mix(hashes * _M + one + np.uint64(2))
    return [_mix(words + np.uint64(1)) >> np.uint64(64 - bits[0]), pair >> keep, _mix(pair * _M + two + np.uint64(3)) >> keep]


def _words_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, sizes of documents, which tokens are to be learnt from, and hashes of a block's words."""
    tokens, sizes = _unpack(row["tokens"], np.int32), np.asarray(row["sizes"], dtype=np.int64)
    train = np.repeat(np.asarray(row["train"], dtype=bool), sizes)
    return tokens, sizes, train, _hashes(row["hashes"], int(tokens.max()) + 1)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def count_runs(blocks: DataFrame, bits: tuple[int, int], ranges: int) -> DataFrame:
    """``block, totals``: for each block and order, how often all training texts have each of its runs.

    A block sends its distinct keys once, dealt by range; a range adds up what it gets and answers each
    block in the order of its keys. A word or run that is everywhere is one key of each block.
    """
    sent_schema = "ord int, range int, block long, keys binary, counts binary"
    schema = "block long, ord int, range int, totals binary"
    shifts = [np.uint64(b - ranges.bit_length() + 1) for b in (bits[0], bits[1], bits[1])]

    def keys_of(batches):
        for row in _rows(batches):
            tokens, sizes, train, words = _words_of(row)
            learnt = [np.bincount(tokens[train], minlength=len(words)), train, train]
            for order, keys in enumerate(run_keys(words, tokens, np.cumsum(sizes) - sizes, bits)):
                place = np.argsort(keys)
                keys = keys[place]
                edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                counts, keys = np.add.reduceat(learnt[order][place].astype(np.int64), edge).astype(np.uint32), keys[edge]
                cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << shifts[order])
                out = []
                for r in range(ranges):
                    a, b = int(cuts[r]), int(cuts[r + 1])
                    if a < b:
                        steps = np.diff(keys[a:b], prepend=np.uint64(r) << shifts[order])
                        out.append((order, r, row["block"], _pack(steps), _pack(counts[a:b])))
                yield _record(list(zip(*out, strict=True)), sent_schema)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_, keys, counts, order, r = [], [], [], 0, 0
        for row in _rows(parts):
            order, r = row["ord"], row["range"]
            blocks_.append(row["block"])
            keys.append(np.cumsum(_unpack(row["keys"], np.uint64)))
            counts.append(_unpack(row["counts"], np.uint32))
        ends = np.cumsum([len(k) for k in keys])
        flat = np.concatenate(keys)
        order_of = np.argsort(flat)
        flat = flat[order_of]
        edge = np.r_[True, flat[1:] != flat[:-1]]
        sums = np.add.reduceat(np.concatenate(counts)[order_of].astype(np.int64), np.flatnonzero(edge))
        totals = np.empty(len(flat), dtype=np.int64)
        totals[order_of] = sums[np.cumsum(edge) - 1]
        out = [(b, order, r, _pack(t)) for b, t in zip(blocks_, np.split(totals, ends[:-1]), strict=True)]
        yield _record(list(zip(*out, strict=True)), schema)

    sent = blocks.select("block", "sizes", "train", "tokens", "hashes").mapInArrow(tidy(keys_of), sent_schema)
    answers = sent.groupBy("ord", "range").applyInArrow(add, schema)
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("ord", "range", "totals"))).alias("totals"))


def counted_blocks(blocks: DataFrame, bits: tuple[int, int], ranges: int) -> DataFrame:
    """The blocks with the counts of their words, and of the runs of two and three that end with each token."""

    def run(batches):
        for row in _rows(batches):
            tokens, sizes, _, words = _words_of(row)
            found: list[list] = [[] for _ in range(ORDERS)]
            for answer in row["totals"]:
                found[answer["ord"]].append(_unpack(answer["totals"], np.int64))
            counts = []
            for keys, totals in zip(run_keys(words, tokens, np.cumsum(sizes) - sizes, bits), found, strict=True):
                order = np.argsort(keys)
                ordered, total = keys[order], np.concatenate(totals)
                place = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
                if place[-1] + 1 != len(total):
                    raise ValueError("a block was not the same when it was read again")
                own = np.empty(len(keys), dtype=np.int64)
                own[order] = total[place]
                counts.append([_pack(own)])
            kept = ("doc_ids", "sizes", "bytes", "train", "tokens", "classes", "tails")
            yield _record([[row[c]] for c in kept] + counts, COUNTED_SCHEMA)

    return blocks.join(count_runs(blocks, bits, ranges), "block").mapInArrow(tidy(run), COUNTED_SCHEMA)


class Part:
    """Some documents of a counted block."""

    def __init__(self, block: dict, a: int, b: int, texts: int):
        starts = block["starts"]
        lo, hi = int(starts[a]), int(starts[b - 1] + block["sizes"][b - 1])
        self.sizes, self.starts = block["sizes"][a:b], starts[a:b] - lo
        self.doc = np.repeat(np.arange(b - a), self.sizes)
        self.train = block["train"][a:b][self.doc]
        self.classes, self.tails = block["classes"][lo:hi].astype(np.int64), block["tails"][lo:hi].astype(np.int64)
        self.total = block["one"][lo:hi]
        # what other tokens have seen
        own = self.train.astype(np.int64)
        self.one, self.two, self.three = (block[n][lo:hi] - own for n in ("one", "two", "three"))
        # how often the one word, and the two words, before a token were seen before other tokens
        first = texts - own[self.starts]
        self.seen_one, self.seen_two = _before(self.one, self.starts, 1), _before(self.two, self.starts, 1)
        self.seen_one[self.starts] = self.seen_two[self.starts] = first


def parts_of(row: dict, texts: int) -> Iterator[tuple[int, int, Part]]:
    """Ranges of a counted block's documents of about PART tokens."""
    block = {"sizes": np.asarray(row["sizes"], dtype=np.int64), "train": np.asarray(row["train"], dtype=bool)}
    block["starts"] = np.cumsum(block["sizes"]) - block["sizes"]
    tokens = _unpack(row["tokens"], np.int32)
    block |= {n: _unpack(row[n], np.uint8)[tokens] for n in ("classes", "tails")}
    block |= {"one": _unpack(row["one"], np.int64)[tokens]} | {n: _unpack(row[n], np.int64) for n in ("two", "three")}
    at = total = 0
    sizes = block["sizes"].tolist()
    for i, n in enumerate(sizes):
        total += n
        if total >= PART or i == len(sizes) - 1:
            yield at, i + 1, Part(block, at, i + 1, texts)
            at, total = i + 1, 0


def _log2(n: np.ndarray) -> np.ndarray:
    """0 for 0, 1 for 1, 2 for 2 and 3, and so on."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _run_length(known: np.ndarray, part: Part) -> np.ndarray:
    """How many tokens of the text just before each one were ``known``, as a power of two up to 7."""
    at = np.arange(len(known))
    last = np.maximum.accumulate(np.where(known, -1, at))
    last = np.maximum(np.r_[-1, last[:-1]], part.starts[part.doc] - 1)
    return np.minimum(_log2(at - 1 - last), 7)


def events(part: Part):
    """For each place of a bit: which tokens have one there, the bit, and its slots in the contexts' tables."""
    before = _before(part.classes, part.starts, 1)
    q1, q2 = np.minimum(_log2(part.seen_one), 31), np.minimum(_log2(part.seen_two), 31)
    three, two = part.three > 0, part.two > 0
    asked = np.flatnonzero(part.seen_two > 0)
    run = _run_length(three, part)
    yield 0, asked, three[asked], [(q2 * 8 + run)[asked], (before * 32 + q2)[asked], (q2 * 32 + q1)[asked]]
    asked = np.flatnonzero(~three & (part.seen_one > 0))
    run = _run_length(two, part)
    yield 1, asked, two[asked], [(q1 * 8 + run)[asked], (before * 32 + q1)[asked], (q1 * 32 + q2)[asked]]
    left = np.flatnonzero(~three & ~two)
    earlier, letter = _before(part.classes, part.starts, 2)[left], _before(part.tails, part.starts, 1)[left]
    last, code = before[left], part.classes[left] | CLASSES
    for i in range(BITS):
        node = code >> (BITS - i)
        contexts = [node, (last << BITS) | node, (((earlier << BITS) | last) << BITS) | node, (((letter << BITS) | last) << BITS) | node]
        yield 2 + i, left, (code >> (BITS - 1 - i)) & 1 == 1, contexts


def _layout() -> tuple[list[list[int]], int]:
    """Where the table of each place's each context begins, and the end; the bits of a class share theirs."""
    begins, at = [], 0
    for sizes in (ASKED, ASKED, CODED):
        begins.append([])
        for n in sizes:
            begins[-1].append(at)
            at += 2 * n
    return begins, at


BEGINS, TABLE = _layout()


def _places(place: int, slots: list, bit) -> list[np.ndarray]:
    return [begin + 2 * s + bit for begin, s in zip(BEGINS[min(place, 2)], slots, strict=True)]


def bit_counts(counted: DataFrame, texts: int) -> np.ndarray:
    """The contexts' tables over all training texts, added up in pieces and in two levels."""
    step = -(-TABLE // PIECES)

    def count(batches):
        table = np.zeros(step * PIECES, dtype=np.int64)
        for row in _rows(batches):
            for _, _, part in parts_of(row, texts):
                for place, at, bit, slots in events(part):
                    on = part.train[at]
                    for s in _places(place, [s[on] for s in slots], bit[on].astype(np.int64)):
                        lo = int(s.min()) if len(s) else 0
                        found = np.bincount(s - lo)
                        table[lo : lo + len(found)] += found
        if table.any():
            group = TaskContext.get().partitionId() % 64
            yield _record([list(range(PIECES)), [group] * PIECES, [_pack(p) for p in np.split(table, PIECES)]], "piece int, part int, counts binary")

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = 0, {}
        for batch in parts:
            for last in _rows([batch]):
                total = total + _unpack(last["counts"], np.int64)
        yield _record([[last["piece"]], [last["part"]], [_pack(total)]], "piece int, part int, counts binary")

    schema = "piece int, part int, counts binary"
    own = counted.mapInArrow(tidy(count), schema).groupBy("piece", "part").applyInArrow(add, schema)
    table = np.zeros(step * PIECES, dtype=np.float32)
    for r in own.groupBy("piece").applyInArrow(add, schema).collect():
        table[r["piece"] * step : (r["piece"] + 1) * step] = _unpack(r["counts"], np.int64)
    return table


def logits(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each slot says, as a logit and as whether it is well known, in three versions.

    As it is, without one 0 and without one 1: a training text's own bit is taken out of the counts.
    """
    n0, n1 = table[::2], table[1::2]
    said, known = np.zeros((len(n0), 4), dtype=np.float32), np.zeros((len(n0), 4), dtype=bool)
    for k, (a, b) in enumerate(((n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0)))):
        said[:, k] = np.log((b + np.float32(0.2)) / (a + np.float32(0.2)))
        known[:, k] = a + b >= KNOWN
    return said.ravel(), known.ravel()


def inputs(part: Part, tables: tuple[np.ndarray, np.ndarray]):
    """For each place: its tokens, their bits, logits of the contexts and a one, and the gate."""
    said, known = tables
    for place, at, bit, slots in events(part):
        version = part.train[at] * (1 + bit.astype(np.int64))
        x = np.zeros((len(at), INPUTS), dtype=np.float32)
        for i, (begin, s) in enumerate(zip(BEGINS[min(place, 2)], slots, strict=True)):
            where = 4 * (s + begin // 2) + version
            x[:, i] = said[where]
            if i == 2 and place > 1:
                gate = known[where]
        x[:, INPUTS - 1] = 1
        yield place, at, bit, x, gate if place > 1 else (slots[0] & 7) > 0


def _logit(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The sum that the gate picks, row by row, so that a row's does not hang on the others."""
    return np.where(gate, np.einsum("ei,i->e", x, weights[1]), np.einsum("ei,i->e", x, weights[0]))


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


def start_weights() -> np.ndarray:
    """By place, gate and input."""
    weights = np.full((PLACES, 2, INPUTS), 0.3, dtype=np.float32)
    weights[:, :, INPUTS - 1] = 0
    return weights


def slopes(part: Part, tables, weights) -> np.ndarray:
    """First and second derivatives of the training texts' likelihood, by place and gate."""
    total = np.zeros((PLACES, 2, INPUTS + 1, INPUTS))
    for place, at, bit, x, gate in inputs(part, tables):
        train = part.train[at]
        p = _probability(_logit(x, weights[place], gate)).astype(np.float64)
        x, bend, slope = x.astype(np.float64), p * (1 - p) * train, (bit - p) * train
        for g, on in ((0, ~gate), (1, gate)):
            total[place, g, :INPUTS] += x.T @ (x * (bend * on)[:, None])
            total[place, g, INPUTS] += (slope * on) @ x
    return total


def better_weights(weights: np.ndarray, total: np.ndarray) -> np.ndarray:
    """One Newton step by the slopes of all training texts, held a little to where learning starts."""
    bend, slope = total[..., :INPUTS, :], total[..., INPUTS, :] - (weights - start_weights())
    step = np.linalg.solve(bend + np.eye(INPUTS), slope[..., None])[..., 0]
    # the order in which parts are added up shows in the last digits only
    return np.round(weights + step, 4).astype(np.float32)


def learn_weights(counted: DataFrame, tables, texts: int) -> np.ndarray:
    """The shared weights, from the training texts of all blocks; ``tables`` is a broadcast."""
    weights = start_weights()
    for _ in range(PASSES):

        def run(batches, weights=weights):
            total = np.zeros((PLACES, 2, INPUTS + 1, INPUTS))
            for row in _rows(batches):
                for _, _, part in parts_of(row, texts):
                    total += slopes(part, tables.value, weights)
            yield _record([[TaskContext.get().partitionId() % 64], [total.tobytes()]], "part int, total binary")

        def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(np.frombuffer(r["total"]) for b in parts for r in _rows([b]))
            yield _record([[0], [total.tobytes()]], "part int, total binary")

        sums = counted.mapInArrow(tidy(run), "part int, total binary").groupBy("part").applyInArrow(add, "part int, total binary")
        rows = sums.collect()  # at most 64
        if rows:
            total = sum(np.frombuffer(r["total"]) for r in rows)
            weights = better_weights(weights, total.reshape(PLACES, 2, INPUTS + 1, INPUTS))
    return weights


def bits_of_documents(part: Part, tables, weights) -> np.ndarray:
    """Bits that each document's questions and classes take, from the shared weights on.

    Each text adds its own weights, one row for questions and one for classes, from what it has shown
    so far; they are refined between rounds of CHUNK tokens, for all texts of the part at once.
    """
    n = len(part.sizes)
    found = list(inputs(part, tables))
    at = np.concatenate([f[1] for f in found])
    if not len(at):
        return np.zeros(n)
    doc = part.doc[at]
    who = 2 * doc + np.repeat([int(f[0] > 1) for f in found], [len(f[1]) for f in found])
    rounds = (at - part.starts[doc]) // CHUNK
    # by round and by text, and in the order of the places inside; the numbers are all different
    order = np.sort(((rounds * 2 * n + who) << 32) | np.arange(len(at))) & 0xFFFFFFFF
    x = np.concatenate([f[3] for f in found])[order]
    sign = np.concatenate([f[2] for f in found])[order] * np.float32(2) - 1
    z = np.concatenate([_logit(x_, weights[place], gate) for place, _, _, x_, gate in found])[order]
    rounds, who = rounds[order], who[order]
    edge = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (rounds[1:] != rounds[:-1])])
    sizes, seg_who = np.diff(np.r_[edge, len(at)]), who[edge]
    cuts = np.searchsorted(rounds[edge], np.arange(rounds[-1] + 2))
    own, total = np.zeros((2 * n, INPUTS), dtype=np.float32), np.zeros(2 * n)
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if s == e:
            continue
        a, b = int(edge[s]), int(edge[e - 1] + sizes[e - 1])
        xs, now, size = x[a:b], seg_who[s:e], sizes[s:e]
        zs = z[a:b] if a == 0 else z[a:b] + np.einsum("ei,ei->e", xs, np.repeat(own[now], size, axis=0))
        right = _probability(sign[a:b] * zs)  # of the bit that is there
        starts = edge[s:e] - a
        total[now] += np.add.reduceat(-np.log2(np.maximum(right, 1e-7)), starts, dtype=np.float64)
        if b < len(at):
            error = sign[a:b] * (1 - right)
            own[now] += (0.05 * np.add.reduceat(xs * error[:, None], starts) / (size + 200)[:, None]).astype(np.float32)
    return total[::2] + total[1::2]


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    One row per input row over its whole text. Rows for which ``train`` holds are what the model
    learns from; null is not. Words are lower-cased in A-Z, and an end mark is a token too.
    ``score`` is log10 of the probability that mixing gives the text: its bits', and where a word is
    picked, its count's share of what it is picked from, which inside a class is
    (c + 0.1) / (C + 0.1 (V + 1)) for its count c, the class's C and its V distinct words.
    ``base_score`` is that share for a single class of all words, and nothing else. A training text's
    own tokens are taken out of the counts that predict them, but not of ``base_score`` and
    ``n_known``. Null text counts as empty, which is the end mark alone; null ids and repeated rows
    stay; other columns are ignored; an empty table, or one without training rows, works with zero
    counts. A text lies in one block however long it is. ``docs`` is read twice and must be the same.
    """
    spark = docs.sparkSession
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("train").cast("long")).alias("texts")).first()
    tokens, texts = (size["chars"] or 0) // 6 + size["rows"], size["texts"] or 0
    bits = min(62, WORD_SPARE + tokens.bit_length()), min(62, RUN_SPARE + tokens.bit_length())
    ranges = 1 << max(0, (tokens // RANGE_KEYS).bit_length())
    counted = materialize(counted_blocks(blocks_of(rows), bits, ranges))

    def measure(batches):
        for row in _rows(batches):
            on = np.repeat(np.asarray(row["train"], dtype=bool), row["sizes"])
            tokens = _unpack(row["tokens"], np.int32)[on]
            classes, one = _unpack(row["classes"], np.uint8)[tokens], _unpack(row["one"], np.int64)[tokens]
            # a word that is there c times is c times a c-th of a word
            n, v = np.bincount(classes, minlength=CLASSES), np.bincount(classes, 1 / one, minlength=CLASSES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["class", "n", "v"])

    sums = counted.select("sizes", "train", "tokens", "classes", "one").mapInArrow(tidy(measure), "class long, n long, v double")
    held, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        held[r["class"]], kinds[r["class"]] = r["n"], round(r["v"])
    n, v = int(held.sum()), int(kinds.sum())
    tables = spark.sparkContext.broadcast(logits(bit_counts(counted, texts)))
    weights = learn_weights(counted, tables, texts)
    schema = (
        "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double,"
        " score double, bits_per_byte double"
    )

    def run(batches):
        floor = n + ADD * (v + 1)
        for row in _rows(batches):
            of_bytes, trained = np.array(row["bytes"], dtype=np.int64), np.asarray(row["train"], dtype=bool)
            for a, b, part in parts_of(row, texts):
                base = np.bincount(part.doc, np.log10((part.total + ADD) / floor))
                share = (part.one + ADD) / (held[part.classes] - part.train + ADD * (kinds[part.classes] + 1))
                share = np.where(part.two > 0, part.two / np.maximum(part.seen_one, 1), share)
                share = np.where(part.three > 0, part.three / np.maximum(part.seen_two, 1), share)
                score = np.bincount(part.doc, np.log10(share)) - bits_of_documents(part, tables.value, weights) * np.log10(2)
                known = np.bincount(part.doc, part.total > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(trained[a:b]), pa.array(of_bytes[a:b]), pa.array(part.sizes),
                        pa.array(known), pa.array(np.full(b - a, n)), pa.array(base), pa.array(score),
                        pa.array(-score / np.log10(2) / np.maximum(of_bytes[a:b], 1)),
                    ],
                    _names(schema),
                )

    return counted.mapInArrow(tidy(run), schema)
