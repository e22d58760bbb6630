import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import chat, mixing, syncmers, toxicity
from palimpsest.llm.common import ASCII_LOWER, WORDS


# -- chat ---------------------------------------------------------------------------------------


def test_template_is_reversible():
    rng = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "\n", "a", "<\\|", "assistant", ""]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "odd\nrole"]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert chat.masked_text(text, spans) == "".join(t for r, t in turns if r == "assistant")


def test_best_paths_of_reply_trees(spark):
    rng = random.Random(7)
    rows, parent = [], {}
    for tree in range(6):
        names = [f"t{tree}n{i:02d}" for i in range(rng.randint(1, 30))]
        for i, n in enumerate(names):
            parent[n] = None if i == 0 else rng.choice(names[max(0, i - 3) : i])
            rows.append((n, parent[n], float(rng.randint(0, 5))))
    score = {n: s for n, _, s in rows}
    rows += [("cycle1", "cycle2", 1.0), ("cycle2", "cycle1", 1.0), ("orphan", "missing", None)]
    m = spark.createDataFrame(rows, "node string, parent string, score double")
    got = {}
    for r in chat.reply_paths(m, keep=2).collect():
        got.setdefault((r["tree"], r["path"]), {})[r["pos"]] = r["node"]
    inner = set(parent.values())
    want = {}
    for leaf in [n for n in parent if n not in inner]:
        path = [leaf]
        while parent[path[-1]]:
            path.append(parent[path[-1]])
        want.setdefault(path[-1], []).append((-sum(score[n] for n in path), -len(path), leaf, path[::-1]))
    expected = {(t, leaf): dict(enumerate(path)) for t, ps in want.items() for _, _, leaf, path in sorted(ps)[:2]}
    expected["orphan", "orphan"] = {0: "orphan"}
    assert got == expected


def test_conversations(spark):
    data = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "assistant", None), (None, 5, None, "x"), (3, None, "system", "s"), (3, 1, "assistant", "<|im_end|>\n")]
    data += [(4, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(70)]
    c = spark.createDataFrame([(*r, 9) for r in data], "conv_id long, turn long, role string, text string, node int")
    got = {r["conv_id"]: (chat.parse_turns(r["formatted"]), chat.masked_text(r["formatted"], r["loss_spans"])) for r in chat.format_conversations(c).collect()}
    assert got[1] == ([("user", "a"), ("user", "a"), ("assistant", "b")], "b")
    assert got[2] == ([("assistant", "")], "")
    assert got[None] == ([("", "x")], "")
    assert got[3] == ([("system", "s"), ("assistant", "<|im_end|>\n")], "<|im_end|>\n")
    assert [t for _, t in got[4][0]] == [f"turn {i}" for i in range(70)]
    assert chat.format_conversations(c.limit(0)).count() == 0


# -- fingerprints -------------------------------------------------------------------------------


def _xx(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def plain_anchors(text):
    """Closed syncmers written out: (place, upper half of the hash)."""
    units = re.findall(syncmers.UNIT, text)
    assert "".join(units) == text
    h = [_xx(u.encode()) for u in units]
    k, out = syncmers.K, []
    for i in range(max(len(h) - k + 1, min(1, len(h)))):
        w = h[i : i + k]
        if len(w) < k or min(w[0], w[-1]) <= min(w[1:-1]):
            seed = 42
            for x in w:
                seed = _xx(struct.pack("<q", x), seed)
            out.append((i, (seed & (1 << 64) - 1) >> 32))
    return out


def plain_print(text):
    first = {}
    for i, h in plain_anchors(text):
        first.setdefault(h, i)
    least = sorted(first)[: syncmers.SIZE]
    return "-".join([f"{h:08X}" for h in least] + [f"{first[h]:08X}" for h in least])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ({p: q for p, q in zip(f.split("-")[: len(f.split("-")) // 2], f.split("-")[len(f.split("-")) // 2 :], strict=True)} if f else {} for f in (a, b))
    if not x or not y:
        return 0.0
    least = sorted(set(x) | set(y))[: syncmers.SIZE]
    places = sorted((x[h], y[h]) for h in least if h in x and h in y)
    down = sum(q[1] < p[1] for p, q in zip(places, places[1:], strict=False))
    return (len(places) - down) / len(least)


def test_fingerprints_by_hand(spark):
    rng = random.Random(3)
    letters = "etaoin shrdlucmfwypvbgkjqxz.,\n\u00e9\u65e5\u672c\U0001f600AB1"
    texts = ["", "a", "x" * 40, "no vowls hr " * 30, "\u65e5\u672c\u8a9e" * 9]
    texts += ["".join(rng.choices(letters, k=n)) for n in (2, 5, 9, 30, 200, 255, 256, 257, 3000)]
    texts += [texts[-1][:1500] + "an edit" + texts[-1][1500:], texts[-1][1500:] + texts[-1][:1500]]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", syncmers.fingerprint(F.col("t")).alias("f")).collect()
    prints = {r["t"]: r["f"] for r in d}
    assert prints == {t: plain_print(t) for t in texts}
    pairs = [(prints[a], prints[b]) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", syncmers.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    assert all(math.isclose(r["l"], plain_likeness(r["a"], r["b"])) for r in got)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in syncmers.fingerprints(docs, with_anchors=True).collect():
        assert [tuple(a) for a in r["anchors"]] == plain_anchors(texts[r["doc_id"]])


def test_likeness_has_no_jump_with_length(spark):
    """A letter more makes little difference at any length."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7)))
    rows = []
    for n in range(240, 272, 2):
        for _ in range(10):
            t = " ".join(word() for _ in range(90))[:n]
            rows.append((n, t, t + "e"))
    d = spark.createDataFrame(rows, "n int, a string, b string").select("n", *[syncmers.fingerprint(F.col(c)).alias(c) for c in "ab"])
    means = d.groupBy("n").agg(F.avg(syncmers.likeness(F.col("a"), F.col("b"))).alias("l")).collect()
    assert all(r["l"] > 0.85 for r in means)


def test_fingerprints(docs, rows, odd, none):
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs, with_anchors=True).collect()}
    texts = dict(rows)
    assert len(got) == len(rows)
    assert all(got[i]["n_chars"] == len(t or "") for i, t in rows)
    by = {}
    for i, t in rows:
        assert by.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert by[""] == "" and len(set(by.values())) >= len(by) - 2
    assert len(texts) == len(rows)
    assert syncmers.fingerprints(odd).count() == 6 and syncmers.fingerprints(none).count() == 0


def test_next_document_in_a_circle(spark, monkeypatch):
    rng = random.Random(9)
    ids = sorted(rng.sample(range(-50, 5000), 60)) + [10**12, 10**15]
    data = [(i, f"text {i} " + "word " * rng.randint(0, 5)) for i in ids]
    monkeypatch.setattr(syncmers, "WIDTH", 8)
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in syncmers.with_next(d).collect()}
    order = sorted(ids, reverse=True)
    texts = dict(data)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        assert got[a]["next_text"] == texts[b]
        assert got[a]["next_fingerprint"] == got[b]["fingerprint"]
    one = syncmers.with_next(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["text"], r["next_text"]) for r in one] == [("", "")]


def test_likeness_follows_the_common_part(spark):
    rng = random.Random(11)
    a = " ".join(f"w{rng.randint(0, 999)}" for _ in range(800))
    b = " ".join(f"v{rng.randint(0, 999)}" for _ in range(800))
    mixed = " ".join(a.split()[:400] + b.split()[400:])
    df = spark.createDataFrame([(a, a, mixed, b, "")], "a string, same string, mixed string, b string, e string")
    prints = df.select(*[syncmers.fingerprint(F.col(c)).alias(c) for c in df.columns])
    r = prints.select(*[syncmers.likeness(F.col("a"), F.col(c)).alias(c) for c in ("same", "mixed", "b", "e")], syncmers.likeness(F.col("e"), F.col("e")).alias("ee")).first()
    assert r["same"] == 1.0 and r["b"] == 0.0 and r["e"] == 0.0 and r["ee"] == 1.0
    assert 0.15 < r["mixed"] < 0.55


def test_likeness_at_any_length(spark):
    """One character more changes little, wherever the length lies and whatever the script.

    A text of under about thirty letters has one or two anchors, which may all hold the edit.
    """
    rng = random.Random(13)
    pairs = []
    for n in (80, 200, 255, 256, 257, 300, 2000):
        words = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))[:n]
        unspaced = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
        pairs += [(n, "words", words, words + "z"), (n, "unspaced", unspaced, unspaced + "z"), (n, "other", words, words[::-1])]
    df = spark.createDataFrame(pairs, "n int, kind string, a string, b string")
    df = df.select("n", "kind", syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("b"))).alias("l"))
    for r in df.collect():
        assert r["l"] < 0.4 if r["kind"] == "other" else r["l"] > (0.6 if r["n"] < 100 else 0.8), r


# -- language model -----------------------------------------------------------------------------


def _corpus(rng, n):
    kinds = [[f"{p}{rng.randint(0, 60)}" for _ in range(60)] for p in ("abc", "xyz", "mno")]
    return [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(5, 200)))) for i in range(n)]


def test_scores(spark, docs, odd, none):
    data = _corpus(random.Random(6), 150) + [(1000, None), (1001, ""), (1002, "unknown words only")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = {r["doc_id"]: r for r in mixing.score_documents(d, train).collect()}
    tokens = {i: [*WORDS.findall((t or "").translate(ASCII_LOWER)), ""] for i, t in data}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for i, r in got.items() if not r["train"] and i < 1000]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    assert mixing.score_documents(odd, F.lit(None).cast("boolean")).count() == 6
    assert mixing.score_documents(none, F.lit(True)).count() == 0


def test_scores_do_not_depend_on_neighbours(spark):
    """The shared weights come from all training texts, however the rows are dealt to partitions."""
    d = spark.createDataFrame(_corpus(random.Random(16), 400), "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 0
    one, many = (
        {r["doc_id"]: r["score"] for r in mixing.score_documents(d.repartition(n, "doc_id"), train).collect()} for n in (1, 40)
    )
    assert all(math.isclose(one[i], many[i], rel_tol=1e-9) for i in one)


class PlainMixer:
    """The model of ``mixing`` written out token by token, with the weights that learning starts from."""

    def __init__(self, docs, train):
        self.runs, self.table, self.texts = Counter(), Counter(), 0
        self.weights = mixing.start_weights().astype(float)
        for words, learn in zip(docs, train, strict=True):
            for i in range(len(words) * learn):
                for n in (1, 2, 3):
                    self.runs[self.run(words, i, n)] += 1
            self.texts += learn
        for words, learn in zip(docs, train, strict=True):
            for i in range(len(words) * learn):
                for place, slots, bit, _ in self.asked(words, i, 1)[0]:
                    for k, s in enumerate(slots):
                        self.table[min(place, 2), k, s, bit] += 1
        self.vocabulary = {r[0] for r in self.runs if len(r) == 1}
        self.held, self.kinds = Counter(), Counter(map(mixing.class_of, self.vocabulary))
        for w in self.vocabulary:
            self.held[mixing.class_of(w)] += self.runs[w,]

    @staticmethod
    def run(words, i, n):
        return tuple([None] * (n - 1 - i) + words[max(0, i - n + 1) : i + 1])

    def count(self, words, i, n, own):
        return self.runs[self.run(words, i, n)] - own

    def asked(self, words, i, own):
        """The bits of one token and the share of the word in what it is picked from."""
        n1, n2, n3 = (self.count(words, i, n, own) for n in (1, 2, 3))
        seen1, seen2 = (self.count(words, i - 1, n, own) if i else self.texts - own for n in (1, 2))
        q1, q2 = seen1.bit_length(), seen2.bit_length()
        classes = [mixing.class_of(w) for w in words]
        before, earlier = (classes[i - k] if i >= k else 0 for k in (1, 2))
        letter = words[i - 1][-1] & 31 if i and words[i - 1] else 0

        def length(n):
            k = 0
            while k < i and self.count(words, i - 1 - k, n, own) > 0:
                k += 1
            return min(k.bit_length(), 7)

        out = []
        if seen2 > 0:
            out.append((0, (q2 * 8 + length(3), before * 32 + q2, q2 * 32 + q1), int(n3 > 0), length(3) > 0))
        if n3 > 0:
            return out, n3 / seen2
        if seen1 > 0:
            out.append((1, (q1 * 8 + length(2), before * 32 + q1, q1 * 32 + q2), int(n2 > 0), length(2) > 0))
        if n2 > 0:
            return out, n2 / seen1
        for k in range(mixing.BITS):
            node = (classes[i] | mixing.CLASSES) >> (mixing.BITS - k)
            slots = (node, before * 64 + node, (earlier * 64 + before) * 64 + node, (letter * 64 + before) * 64 + node)
            out.append((2 + k, slots, classes[i] >> (mixing.BITS - 1 - k) & 1, None))
        c = classes[i]
        return out, (n1 + 0.1) / (self.held[c] - own + 0.1 * (self.kinds[c] + 1)) if hasattr(self, "held") else None

    def score(self, words, learn):
        total, own, held_back = 0.0, np.zeros((2, mixing.INPUTS)), []
        for i in range(len(words)):
            if i and i % mixing.CHUNK == 0:  # refine by what the last tokens have shown
                for kind in (0, 1):
                    some = [(x, e) for k, x, e in held_back if k == kind]
                    own[kind] += 0.05 * sum((x * e for x, e in some), np.zeros(mixing.INPUTS)) / (len(some) + 200)
                held_back = []
            bits, share = self.asked(words, i, int(learn))
            total += math.log10(share)
            for place, slots, bit, gate in bits:
                x, seen = np.zeros(mixing.INPUTS), []
                for k, s in enumerate(slots):
                    n = [self.table[min(place, 2), k, s, b] - (learn and b == bit) for b in (0, 1)]
                    x[k] = math.log((n[1] + 0.2) / (n[0] + 0.2))
                    seen.append(sum(n))
                x[-1] = 1
                gate = seen[2] >= mixing.KNOWN if gate is None else gate
                p = 1 / (1 + math.exp(-max(-15, min(15, x @ (self.weights[place, int(gate)] + own[int(place > 1)])))))
                total += math.log10(max(p if bit else 1 - p, 1e-7))
                held_back.append((int(place > 1), x, bit - p))
        return total


def _tokens(text):
    return [w.encode() for w in WORDS.findall(text.translate(ASCII_LOWER))] + [b""]


def test_scores_against_a_plain_mixer(spark, monkeypatch):
    rng = random.Random(31)
    data = _corpus(rng, 60)
    data += [(500, data[0][1]), (501, " ".join(t for _, t in data[:9])), (502, ""), (503, "never seen words here"), (504, data[1][1] + " tail")]
    monkeypatch.setattr(mixing, "PASSES", 0)
    monkeypatch.setattr(mixing, "RUN_SPARE", 40)
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: (r["score"], r["train"]) for r in mixing.score_documents(d, F.col("doc_id") % 4 != 0).collect()}
    docs, learn = [_tokens(t) for _, t in data], [i % 4 != 0 for i, _ in data]
    plain = PlainMixer(docs, learn)
    assert max(map(len, docs)) > 2 * mixing.CHUNK
    for (i, _), words, y in zip(data, docs, learn, strict=True):
        assert got[i][1] == y
        assert math.isclose(got[i][0], plain.score(words, y), rel_tol=1e-4), i


def test_probabilities_add_up_to_one_at_most():
    rng = random.Random(32)
    docs = [_tokens(t) for _, t in _corpus(rng, 30)]
    plain = PlainMixer(docs, [True] * len(docs))
    for prefix in (docs[3][:1], docs[4][:7], [b"unseen"], []):
        start = plain.score(prefix, False) if prefix else 0.0
        unknown = {}
        for n in range(3000):  # one word for the place of unknown words of each class
            unknown.setdefault(mixing.class_of(b"%04d" % n * 3), b"%04d" % n * 3)
        words = [w for w in unknown.values() if w not in plain.vocabulary]
        total = sum(10 ** (plain.score([*prefix, w], False) - start) for w in [*plain.vocabulary, *words])
        assert 0.2 < total < 1 + 1e-6


def test_a_text_that_occurs_twice_scores_apart(spark):
    rng = random.Random(33)
    data = _corpus(rng, 80)
    data += [(900 + i, t) for i, t in data[:5]]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in mixing.score_documents(d, F.lit(True)).collect()}
    twice = {i for i, _ in data[:5]} | {900 + i for i, _ in data[:5]}
    assert max(got[i] for i in twice) < min(b for i, b in got.items() if i not in twice)


# -- toxicity -----------------------------------------------------------------------------------


def _toxic_corpus(rng, n):
    plain = ["".join(rng.choice(["ta", "ri", "mon", "del", "sha", "ber", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["grumbfitz", "wexquat", "zorkheap"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, odd, none):
    data = _toxic_corpus(random.Random(8), 600)
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 9) for i, _, y in data if i % 3] + [(None, 1, 9), (7, None, 9)], "doc_id long, toxic int, text int")
    model = toxicity.train(d, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD, y == 1) for i, _, y in data if not i % 3]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.toxicity(odd, model).count() == 6 and toxicity.toxicity(none, model).count() == 0
    left = toxicity.drop_toxic(d, model)
    assert {r["doc_id"] for r in left.collect()} == {i for i, s in got.items() if s < toxicity.THRESHOLD}
    blank = toxicity.train(d, labels.limit(0))
    assert {r["score"] for r in toxicity.toxicity(d.limit(5), blank).collect()} == {0.0}


def test_toxic_passages_far_into_a_text(spark):
    rng = random.Random(21)
    plain = ["".join(rng.choice(["ta", "ri", "mon", "del", "sha", "ber", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    data = []
    for i in range(120):
        words = [rng.choice(plain) for _ in range(4000)]
        if i % 3 == 0:
            words += [w for _ in range(40) for w in ("grumbfitz", rng.choice(plain), "zorkheap", rng.choice(plain))]
        data.append((i, " ".join(words), int(i % 3 == 0)))
    assert all(" ".join(t.split()[:4000])[:20_000] == t[:20_000] for _, t, _ in data)
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 2], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert b"grumbfitz" in model.toxic
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(d, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD, y == 1) for i, _, y in data if i % 2 == 0]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_digest_of_formatted_text_is_stable():
    text, spans = chat.format_turns([("user", "hi"), ("assistant", "ok")])
    assert text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["ok"]
    assert hashlib.sha256(text.encode()).hexdigest()
