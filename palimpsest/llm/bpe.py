"""Byte-pair encoding of a public word vocabulary, written out step by step.

``BpeModel`` reads a tokenizers JSON file of the kind "NFC, white space, lower case, split pattern,
byte letters, merges with a word end" and offers two ways to merge a pre-token: a priority queue
over a linked list (encoding) and rank-synchronous merging of ragged arrays (counting).
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

#: Marks that are a pre-token of their own after a word.
_STOPS = frozenset(",.;:!?")
_NONE = np.iinfo(np.int64).max
#: Letters and marks that Python's tables and the library's put into the same classes, in Unicode 4 and
#: unchanged since: Latin, Greek, Cyrillic, general punctuation, kana and the older ideographs. A word with
#: any other is normalised and split by the library itself.
_PLAIN = regex.compile("[\x00-\u017F\u0391-\u03A9\u03B1-\u03C9\u0410-\u044F\u2010-\u2027\u2030-\u205E\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5]*")
#: Words of Latin letters that have one code point each, which are one pre-token, with at most one mark behind.
_LATIN = regex.compile("[a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+[,.;:!?]?")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class BpeModel:
    """Vocabulary, merges and pre-tokenisation of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.by_byte = dict(enumerate(self.letters))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.normalize, self.split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        keys = np.array([(a << 32) | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)
        made = np.array([m for _, m in self.merges.values()], dtype=np.int64)
        self.pair_rank, self.pair_made = ranks[order], made[order]

    def pretokens(self, text: str) -> list[str | int]:
        """Byte-letter strings of the pre-tokens; special strings come as their ids."""
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if text.isascii() and text[-1:] in _STOPS and text[:-1].isalpha():
            return [text[:-1].lower(), text[-1]]
        if _LATIN.fullmatch(text):
            if text[-1] in _STOPS:
                return [self.in_letters(text[:-1].lower()), text[-1]]
            return [self.in_letters(text.lower())]
        parts = self.special_split.split(text) if self.special_split else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part and not _PLAIN.fullmatch(part):
                out += [piece for piece, _ in self.split(self.normalize(part))]
            elif part:
                norm = part if part.isascii() else unicodedata.normalize("NFC", part)
                # each letter is lowered by itself: the final sigma gets no form of its own
                norm = norm.lower() if "\u03a3" not in norm else "".join(c.lower() for c in norm)
                for word in self.pattern.findall(norm):
                    if word.isascii() and word.isprintable():
                        out.append(word)
                    else:
                        out.append(self.in_letters(word))
        return out

    def in_letters(self, word: str) -> str:
        """The letters that stand for the word's UTF-8 bytes."""
        return word.encode("utf-8").decode("latin-1").translate(self.by_byte)

    def symbols(self, pretoken: str) -> list[int]:
        """Ids of the pre-token's letters, the last with the word end."""
        v = self.vocab
        return [v[c] for c in pretoken[:-1]] + [v[pretoken[-1] + self.end]]

    def merge_queue(self, symbols: list[int]) -> list[int]:
        """Merge by a queue of (rank, place) over a doubly linked list; stale entries are skipped."""
        n = len(symbols)
        if n < 2:
            return symbols
        sym = list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                queue.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if j < 0 or sym[i] != a or sym[j] != b:  # the pair is gone
                continue
            sym[i], sym[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, sym[k])):
                    heapq.heappush(queue, (m[0], i, made, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], made))):
                heapq.heappush(queue, (m[0], h, sym[h], made, m[1]))
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = after[i]
        return out

    def count_synchronous(self, words: list[list[int]]) -> np.ndarray:
        """Symbols left of each word once merging ends.

        The words lie in one flat array with a row number per symbol. Each round looks up the rank
        of every adjacent pair, takes each row's lowest rank and merges all its occurrences (left
        to right where they overlap) in all rows at once, until no row has a pair.
        """
        counts = np.array([len(w) for w in words], dtype=np.int64)
        if not len(words) or counts.max(initial=0) < 2:
            return counts
        sym = np.concatenate([np.asarray(w, dtype=np.int64) for w in words if w])
        row = np.repeat(np.arange(len(words)), counts)
        rank, made = self._look_up(sym, row, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            counts[row[starts]] = sizes
            live = low < _NONE
            if not live.all():  # rows without a pair are done
                on = np.repeat(live, sizes)
                sym, row, rank, made = sym[on], row[on], rank[on], made[on]
                low, sizes = low[live], sizes[live]
                if not len(sym):
                    break
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            # where the same pair overlaps itself (a a a), every second place of the run merges
            run = np.flatnonzero(np.r_[True, np.diff(places) != 1])
            within = np.arange(len(places)) - np.repeat(run, np.diff(np.r_[run, len(places)]))
            places = places[(sym[places] != sym[places + 1]) | (within % 2 == 0)]
            sym[places] = made[places]
            alive = np.ones(len(sym), dtype=bool)
            alive[places + 1] = False
            new = np.cumsum(alive)[places] - 1
            sym, row, rank, made = sym[alive], row[alive], rank[alive], made[alive]
            at = np.unique(np.r_[new, new[new > 0] - 1])
            rank[at], made[at] = self._look_up(sym, row, at)
        return counts

    def _look_up(self, sym, row, at):
        """Rank and merged symbol of the pairs that start at the places ``at``."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = (sym[at] << 32) | sym[nxt]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = (self.pair_keys[found] == key) & (row[at] == row[nxt]) & (nxt != at)
        return np.where(ok, self.pair_rank[found], _NONE), self.pair_made[found]

    def decode(self, ids) -> str:
        """Vocabulary strings joined, with nothing else done to them."""
        return " ".join(self.pieces[i] for i in ids)
