"""Token counts, BPE encoding and decoding, and library token ids, over whole texts.

Merges never cross white space, so each distinct word is tokenised once per worker and looked up
afterwards. The cache has two generations of bounded size: what is used again survives, the rest
goes, and a worker's memory does not grow with the corpus.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .bpe import BpeModel

#: Characters of text handled at once, and entries of one cache generation.
SLICE_CHARS = 1 << 20
GENERATION = 200_000


class WordCache:
    """Values by word; ``fill(words)`` makes those of unknown words."""

    def __init__(self, fill, generation: int = GENERATION):
        self.fill, self.generation = fill, generation
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, words) -> dict:
        """A dict that holds every word of ``words``."""
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        todo = []
        for w in words:
            if w in young:
                continue
            v = old.get(w)
            if v is None:
                todo.append(w)
            else:
                young[w] = v
        if todo:
            todo = list(dict.fromkeys(todo))
            young.update(zip(todo, self.fill(todo), strict=True))
        return young


def slices(batch: pa.RecordBatch):
    """(ids, texts) of some rows of a two-column batch, about SLICE_CHARS characters at a time."""
    return _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), "")


def byte_slices(batch: pa.RecordBatch):
    """The same with the texts' UTF-8 bytes."""
    return _slices(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), b"")


def _slices(ids: list, texts: list, empty):
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or empty)
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield ids[at : i + 1], [t or empty for t in texts[at : i + 1]]
            at, size = i + 1, 0


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has; texts have no nulls."""
    lists = pc.ascii_split_whitespace(texts)
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if real.all():
        return words, counts.astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)[real]
    return words.filter(pa.array(real)), np.bincount(owner, minlength=len(counts))


class CodedSlice:
    """Some texts as numbers of their distinct words, which are looked up once each.

    Words are lower-cased in A-Z, as the tokenizer would do in time. Other white space than ASCII's
    stays inside "words"; a text that may hold special strings keeps its case, for those are looked
    up before.
    """

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.bytes = ids, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = pc.invert(pc.match_substring(texts, "<|"))
        lower = pc.ascii_lower(texts)
        words, self.counts = ascii_words(lower if pc.all(plain).as_py() else pc.if_else(plain, lower, texts))
        coded = words.dictionary_encode()
        self.words = coded.dictionary.cast(pa.binary()).to_pylist()
        self.index = coded.indices.to_numpy()

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's words of what each distinct word has."""
        total = np.r_[0, np.cumsum(values[self.index], dtype=np.int64)]
        ends = np.cumsum(self.counts)
        return total[ends] - total[ends - self.counts]

    def joined(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each text has; a word's are little-endian bytes."""
        flat = np.frombuffer(b"".join(values), dtype="<i4")
        sizes = np.array([len(v) // 4 for v in values], dtype=np.int64)
        n = sizes[self.index]
        # from a place among all ids to the place of the same id among the distinct words' ids
        shift = (np.cumsum(sizes) - sizes)[self.index] - (np.cumsum(n) - n)
        return flat[np.repeat(shift, n) + np.arange(n.sum())], self.by_text(sizes)


def coded_slices(batch: pa.RecordBatch):
    """The rows of a two-column batch of id and text, about SLICE_CHARS bytes at a time; null texts count as empty."""
    texts = pc.fill_null(batch.column(1), "")
    lengths, at, size = pc.binary_length(texts).to_pylist(), 0, 0
    for i, n in enumerate(lengths):
        size += n
        if size >= SLICE_CHARS or i == len(lengths) - 1:
            yield CodedSlice(batch.column(0).slice(at, i + 1 - at).to_pylist(), texts.slice(at, i + 1 - at))
            at, size = i + 1, 0


_models: dict[str, BpeModel] = {}


def model_at(path: str) -> BpeModel:
    if path not in _models:
        _models[path] = BpeModel(path)
    return _models[path]


def _pretoken_cache(model: BpeModel, fill) -> WordCache:
    """A word cache over a pre-token cache, for words share pre-tokens ("the" and "the,")."""
    inner = WordCache(fill)

    def words(todo):
        # most words are lower-case ASCII letters and nothing else
        split = [[w.decode()] if w.isalpha() and w.islower() else model.pretokens(w.decode()) for w in todo]
        known = inner.ready([p for row in split for p in row if not isinstance(p, int)])
        return [(row, known) for row in split]

    return words


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens``: one row per input row, by rank-synchronous array merging.

    The new pre-tokens of a slice of texts lie in one ragged array; every round merges each
    pre-token's lowest-rank pair in all of them at once, and what is left is counted. Special
    strings inside a text are one token each. Null and empty texts have 0 bytes and 0 tokens; null
    ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        model = model_at(path)
        split = _pretoken_cache(model, lambda ps: model.count_synchronous([model.symbols(p) for p in ps]).tolist())
        cache = WordCache(lambda ws: [sum(1 if isinstance(p, int) else known[p] for p in row) for row, known in split(ws)])
        for batch in batches:
            for part in coded_slices(batch):
                known = cache.ready(part.words)
                counts = part.by_text(np.array([known[w] for w in part.words], dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.ids, pa.int64()), pa.array(part.bytes), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"]
                )

    return _two(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: one row per input row.

    Each new pre-token is merged by a priority queue of merge ranks over a doubly linked symbol
    list. Null and empty texts have an empty list; null ids and repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches):
        model = model_at(path)
        split = _pretoken_cache(
            model, lambda ps: [np.array(model.merge_queue(model.symbols(p)), "<i4").tobytes() for p in ps]
        )
        special = {i: np.array([i], "<i4").tobytes() for i in model.special.values()}
        cache = WordCache(
            lambda ws: [b"".join([special[p] if isinstance(p, int) else known[p] for p in row]) for row, known in split(ws)]
        )
        for batch in batches:
            for part in coded_slices(batch):
                known = cache.ready(part.words)
                flat, counts = part.joined([known[w] for w in part.words])
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(part.ids, pa.int64()), lists], ["doc_id", "ids"])

    return _two(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``out_col``: the vocabulary strings of the ids, one space between.

    A null or empty list gives the empty text. An id outside the vocabulary is an error. A column
    of that name that is there already is replaced.
    """
    kept = [c for c in encoded.columns if c != out_col]
    encoded = encoded.select(*[encoded[c] for c in kept])
    schema = StructType([*encoded.schema.fields, StructField(out_col, StringType())])
    place = kept.index(ids_col)

    def run(batches):
        pieces = model_at(path).pieces
        at_place = {i: n for n, i in enumerate(pieces)}
        strings = pa.array(list(pieces.values()), pa.string())
        places = np.full(max(pieces) + 1, -1, dtype=np.int64)
        places[list(at_place)] = list(at_place.values())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pc.fill_null(part.column(place), pa.scalar([], part.column(place).type))
                counts = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(places) or places[flat].min() < 0):
                    raise KeyError("an id is outside the vocabulary")
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                texts = pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(pa.array(places[flat]))), " ")
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*kept, out_col])

    return encoded.mapInArrow(run, schema)


def library_fill(path: str):
    """Ids of words, as little-endian bytes: merged by the tokenizers library.

    The library's model is called with the pre-tokens, which spares its bookkeeping of offsets.
    """
    model = model_at(path)
    tokenize = model.library.model.tokenize
    split = _pretoken_cache(model, lambda ps: [array("I", [t.id for t in tokenize(p)]).tobytes() for p in ps])
    special = {i: array("I", [i]).tobytes() for i in model.special.values()}

    def fill(words: list[bytes]) -> list[bytes]:
        return [
            known[row[0]] if len(row) == 1 and row[0] in known else
            b"".join([special[p] if isinstance(p, int) else known[p] for p in row])
            for row, known in split(words)
        ]

    return fill
