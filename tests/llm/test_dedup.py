import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, minhash, substrings
from palimpsest.llm.common import ASCII_LOWER, WORDS
from palimpsest.llm.links import components


def test_exact_dedup(docs, rows):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, keep="max").collect()}
    norm = {i: (t or "").translate(ASCII_LOWER) for i, t in rows}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        want = (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == want
    assert len(got) == len(rows)


def test_exact_dedup_with_colliding_hashes(docs, rows):
    """With a hash that has four values only, texts are still told apart."""
    def tiny(c):
        return F.pmod(F.crc32(c), F.lit(4))

    a = exact_dedup.exact_dedup(docs, hash_fn=tiny).orderBy("doc_id").collect()
    assert a == exact_dedup.exact_dedup(docs).orderBy("doc_id").collect()
    left = exact_dedup.drop_exact_copies(docs, hash_fn=tiny)
    assert left.columns == docs.columns
    assert left.count() == len({(t or "").translate(ASCII_LOWER) for _, t in rows})


def test_exact_dedup_odd_rows(odd, none):
    got = sorted(exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert [tuple(r) for r in got if r["doc_id"] == 5] == [(5, 5, 3, True)] * 2
    assert {(r["keep_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(5, False), (None, True)}
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.drop_exact_copies(odd).count() == 4


def brute_components(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp, sets


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    comp, sets = brute_components(rows, percent)
    got = minhash.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), comp[i], comp[i] == i)
    left = minhash.drop_near_duplicates(docs, percent)
    assert left.columns == docs.columns
    assert left.count() == sum(comp[i] == i for i in comp)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large bucket is split into blocks and still loses no link."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"e{rng.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 7)
    comp, _ = brute_components(rows, 85)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == comp


def test_near_duplicates_odd_rows(odd, none):
    got = minhash.near_duplicates(odd, 85).collect()
    assert len(got) == 6
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, False)}
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] == 5} == {(5, True)}
    assert minhash.near_duplicates(none).count() == 0


def test_min_and_max_agree_as_often_as_sets_do():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    seeds = minhash.seeds_for(2000)
    same = (minhash.signature(a, seeds) == minhash.signature(b, seeds)).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.04
    assert minhash.bands_for(0.85)[1] == 6


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (7, 7), (5, 1), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 6)} | {8: 8, 9: 8} | {i: 100 for i in range(100, 141)}
    assert got == want


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lost = [False] * len(w)
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            if x in seen:
                lost[p : p + window] = [True] * window
            seen.add(x)
        out[i] = (len(w), sum(lost), " ".join(a for a, gone in zip(w, lost, strict=True) if not gone))
    return out


@pytest.mark.parametrize("long_from", [5000, 1])
def test_substring_dedup(docs, rows, monkeypatch, long_from):
    """With short and with long prefixes only, the result is the same."""
    monkeypatch.setattr(substrings, "LONG_FROM", long_from)
    want = brute_repeats(rows)
    got = substrings.substring_dedup(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 200
    for r in got:
        assert sum(s["end"] - s["begin"] for s in r["removed"]) == r["n_removed"]
    left = substrings.drop_repeats(docs)
    assert left.columns == docs.columns
    assert left.count() == sum(n == 0 or m < n for n, m, _ in want.values())


def test_substring_dedup_odd_rows(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(30))
    data = [(4, long), (4, long), (None, long), (3, long + " tail"), (9, None)]
    got = substrings.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 30), (3, 0), (4, 30), (4, 30), (9, 0)]
    assert substrings.substring_dedup(odd).count() == 6
    assert substrings.substring_dedup(none).count() == 0


def test_a_window_that_is_everywhere(spark):
    """Rows of one key over many batches, folded on the way, give what one pass over all of them gives."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    window, n = 20, 5000
    words = rng.integers(0, 1 << 32, window, dtype=np.uint32).tobytes()
    d = rng.permutation(n).astype(np.int64)
    names = ["key", "d", "tp", "words", "left", "marks"]

    def batches(size):
        for at in range(0, n, size):
            m = len(d[at : at + size])
            columns = [np.full(m, 7), d[at : at + size], np.full(m, 1 << 32), [words] * m, np.full(m, 3, np.int32), np.zeros(m, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    old, found = substrings.FOLD, []
    try:
        for fold, size in ((1 << 30, n), (500, 200), (1, 1000)):
            substrings.FOLD = fold
            found.append(sorted(r["d"] for b in substrings._subtrees(window, 6)(batches(size)) for r in b.to_pylist()))
    finally:
        substrings.FOLD = old
    assert found[0] == list(range(1, n)) and found[1] == found[0] and found[2] == found[0]
