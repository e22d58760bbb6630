import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from palimpsest.llm.common import ASCII_LOWER

from .test_dedup import brute_components, brute_repeats


def test_stages_on_a_small_folder(spark, rows, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    data = [(i, t or "", "en", "s", len(t or "")) for i, t in rows]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: [r[k] for r in data] for k, n in enumerate(names)}), tmp_path / "documents.parquet")
    labels = pa.table({"doc_id": [0, 7, 14], "quality": [1, 1, 1], "toxic": [0, 0, 0]})
    pq.write_table(labels, tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    assert len(kept["toxicity"]) == len(rows)
    exact = {r["doc_id"]: r["text"] for r in kept["exact_dedup"]}
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        first.setdefault(t.translate(ASCII_LOWER), i)
    assert set(exact) == set(first.values())
    comp, _ = brute_components(list(exact.items()), 80)
    near = {r["doc_id"]: r["text"] for r in kept["minhash_near_dedup"]}
    assert set(near) == {i for i in comp if comp[i] == i}
    cut = brute_repeats(list(near.items()))
    left = {r["doc_id"]: r for r in kept["substring_dedup"]}
    assert set(left) == {i for i, (n, m, _) in cut.items() if n == 0 or m < n}
    for i, r in left.items():
        assert r["text"] == (cut[i][2] if cut[i][1] else near[i])
        assert r["n_chars"] == len(r["text"])
    assert {r["doc_id"] for r in kept["packing"]} == set(left)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(kept["packing"])


def _write(at, data, labels):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    table = pa.table({n: pa.array([r[k] for r in data], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})
    pq.write_table(table, at / "documents.parquet")
    kinds = [pa.int64(), pa.int32(), pa.int32()]
    pq.write_table(pa.table({n: pa.array([r[k] for r in labels], kinds[k]) for k, n in enumerate(("doc_id", "quality", "toxic"))}), at / "labels.parquet")


def test_toxic_documents_go(spark, tmp_path):
    """With labels to learn from, nulls in every column, a repeated row and an id that is null."""
    rng = random.Random(5)
    plain = ["".join(rng.choice(["ta", "ri", "mon", "del", "sha", "ber", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    data, toxic = [], {}
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic[i] = i % 4 == 0
        for _ in range(len(words) // 15 + 2 if toxic[i] else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbfitz", "wexquat", "zorkheap"]))
        data.append((i, " ".join(words), "en", "s", 1))
    data += [data[1], (None, "a text without an id " * 3, None, None, None), (1000, None, None, None, None)]
    _write(tmp_path, data, [(i, 1, int(toxic[i])) for i in range(200)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()
    left = {r["doc_id"] for r in clean}
    assert sum(toxic[i] for i in left if i is not None and i < 400) <= 4
    assert sum(not y for i, y in toxic.items() if i not in left) <= 4
    assert {None, 1000} <= left and sum(r["doc_id"] == 1 for r in clean) == 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {None, 1, 1000} <= {r["doc_id"] for r in packed}


def test_empty_documents(spark, tmp_path):
    _write(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
