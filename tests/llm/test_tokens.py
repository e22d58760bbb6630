import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing, tokens
from palimpsest.llm.bpe import BpeModel

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = [
    "Hello <|endoftext|>World's aaaaaaaaaa it'll café 12 ñ x<|startoftext|>y ...!? İI ΑΣ Σ", "<|ENDOFTEXT|> <|endoftext|", "é" * 40, "'s't're n't",
    "🙂🙂 ‼️ ﬁ ① Ⅷ ｆｕｌｌ", "́ leading mark", "a,b;c. d! e? (f)", "tab\tfeed\fvt\vnl\ncr\r",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_both_merges_agree_with_the_library(library):
    rng = random.Random(2)
    texts = EXTRA + ["".join(rng.choice("aabbctheingréñ,.' 1\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    model = BpeModel(PATH)
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        parts = model.pretokens(t)
        assert [i for p in parts for i in ([p] if isinstance(p, int) else model.merge_queue(model.symbols(p)))] == want
        words = [model.symbols(p) for p in parts if not isinstance(p, int)]
        assert sum(model.count_synchronous(words)) + sum(isinstance(p, int) for p in parts) == len(want)


def test_counts_encoding_and_decoding(spark, docs, rows, library):
    data = rows + [(1000 + i, t) for i, t in enumerate(EXTRA)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in data}
    for r in tokens.token_counts(d, PATH).collect():
        assert r["n_tokens"] == len(want[r["doc_id"]])
        assert r["n_bytes"] == len((dict(data)[r["doc_id"]] or "").encode())
    both = tokens.bpe_decode(tokens.bpe_encode(d, PATH), PATH).collect()
    assert len(both) == len(data)
    for r in both:
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)


def test_small_caches_give_the_same(spark, docs, monkeypatch):
    want = sorted(tokens.token_counts(docs, PATH).collect())
    monkeypatch.setattr(tokens, "SLICE_CHARS", 200)
    cache = tokens.WordCache(lambda ws: [w * 2 for w in ws], generation=3)
    for i in range(50):
        words = [f"w{i % 7}", f"v{i}"]
        known = cache.ready(words)
        assert [known[w] for w in words] == [w * 2 for w in words]
        assert len(cache.young) + len(cache.old) < 20
    assert sorted(tokens.token_counts(docs, PATH).collect()) == want


def test_odd_rows(odd, none):
    for f in (tokens.token_counts, tokens.bpe_encode):
        assert f(odd, PATH).count() == 6
        assert f(none, PATH).count() == 0
    assert packing.pack(none, PATH).count() == 0
    assert packing.pack(odd, PATH).agg({"length": "sum"}).first()[0] == sum(r["n_tokens"] + 1 for r in tokens.token_counts(odd, PATH).collect())


def test_packing(docs, rows, library):
    got = packing.pack(docs, PATH, capacity=128).collect()
    texts = dict(rows)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids = np.array([*library.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        parts.sort(key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == ids.tobytes()
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
        assert {r["doc_tokens"] for r in parts} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
        total = sum(r["length"] for r in parts)
        assert total <= 128 and total & (total - 1) == 0


def test_best_fill_is_the_best():
    from itertools import product

    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 4)))
        have = {n: rng.randint(1, 3) for n in lengths}
        room = rng.randint(1, 60)
        got = packing.best_fill(lengths, have.get, room)
        best = max(s for c in product(*[range(have[n] + 1) for n in lengths]) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= room)
        assert sum(n * k for n, k in got.items()) == best
        assert all(k <= have[n] for n, k in got.items())


def test_windows_use_every_piece_once():
    for seed in range(60):
        rng, pool, total = random.Random(seed), packing.Pool(), 0
        for d in range(rng.randint(0, 200)):
            n = rng.choice([rng.randint(1, 255), 1, 128, 255])
            pool.add((d, 0, zlib.crc32(b"x").to_bytes(4, "little") * n, n))
            total += n
        full, rest = list(packing.windows(pool, 256, 0)), list(packing.powers(pool))
        sizes = [sum(len(p[2]) // 4 for p in w) for w in full]
        tail = [sum(len(p[2]) // 4 for p in w) for w in rest]
        assert all(s == 256 for s in sizes) and all(s & (s - 1) == 0 for s in tail)
        assert sum(sizes) + sum(tail) == total
