"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
windows of a few words, and each window is compressed with the one and with the other. Where the
toxic dictionary takes fewer bytes, the window holds what toxic texts hold and ordinary ones do not.
The differences of a text's windows, held against several thresholds whose weights are calibrated on
other labelled texts, give its score; how long a text is has no part in it.

zstandard's own dictionary trainer picks segments by how often they occur, which on short windows
of mostly ordinary words leaves out the few that matter. The segments here are picked by the number
of documents of the class that hold them, against the other class, and handed to zstandard as raw
dictionary content, behind what most texts of both classes hold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, materialize, tidy
from .tokens import _two, slices

GRAM = 5
WINDOWS = (12, 24)  # words
CUTS = (1, 2, 3, 4, 6, 8, 10, 12)  # bytes saved
#: Bound of the training sample: documents of each class, each with its whole text.
MAX_DOCS = 3000
#: Distinct segments that a task counts before it hands the counts on.
SEGMENTS = 300_000
THRESHOLD = 0.3
#: zstandard settings for windows of a hundred bytes: thorough search, matches from four bytes.
LEVEL = {
    "write_content_size": False, "write_checksum": False, "write_dict_id": False, "window_log": 17, "hash_log": 15,
    "chain_log": 15, "search_log": 5, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY2,
}


def normal(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def _bytes(words: list[str]) -> bytes:
    return (" " + " ".join(words) + " ").encode()


def _grams(words: list[str]) -> set[bytes]:
    b = _bytes(words)
    return {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}


def _runs(words: list[str], good: set[bytes]) -> set[bytes]:
    """The runs of good grams."""
    s, found, i = _bytes(words), set(), 0
    last = len(s) - GRAM
    while i <= last:
        j = i
        if s[i : i + GRAM] in good:
            while j < last and s[j + 1 : j + 1 + GRAM] in good:
                j += 1
            found.add(s[i : j + GRAM])
        i = j + 1
    return found


def _frequency(docs: DataFrame, segments) -> DataFrame:
    """``segment, toxic, ordinary``: how many documents of each class hold each of their segments."""
    names = ["segment", "toxic", "ordinary"]

    def run(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            found = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(found, pa.binary()), *(pa.array([seen[y][s] for s in found], pa.int64()) for y in (1, 0))]
            for counts in seen:
                counts.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[y].update(segments(normal(text.as_py())))
                if len(seen[0]) + len(seen[1]) >= SEGMENTS:
                    yield flush()
        yield flush()

    own = docs.select("y", "text").mapInArrow(tidy(run), "segment binary, toxic long, ordinary long")
    return own.groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train_dictionaries(
    docs: DataFrame, toxic: int, ordinary: int, size: int = 8192, common_size: int = 20_000,
    least: tuple[float, float] = (0.05, 0.008), lift: tuple[float, float] = (4.0, 100.0),
) -> tuple[bytes, bytes]:
    """Raw dictionary content for toxic and for ordinary text, from so many ``y, text`` of each.

    A class's own segments are runs of grams that at least ``least`` of its documents hold and that
    are ``lift`` times as common there as in the other class (both for ordinary, then for toxic text,
    whose telling words are rarer); behind them come the grams that most
    ordinary documents hold. Texts stay on the executors; what is picked comes to the driver.
    """
    grams = materialize(_frequency(docs, _grams))
    names, n = {1: "toxic", 0: "ordinary"}, {1: max(1, toxic), 0: max(1, ordinary)}
    common = grams.filter("ordinary > 0").orderBy(F.desc("ordinary"), "segment").limit(common_size // GRAM)
    common = sorted(common.collect(), key=lambda r: (-r["ordinary"], bytes(r["segment"])))
    tail = b"".join(bytes(r["segment"]) for r in reversed(common))
    out = []
    for y in (1, 0):
        own, other = F.col(names[y]), F.col(names[1 - y])
        # half a document more; in a small sample less, so that a twentieth of the class is enough where the other has none
        more = min(0.5, n[1 - y] / (20 * lift[y]))
        wanted = (own >= max(2, least[y] * n[y])) & (own / n[y] >= lift[y] * (other + more) / n[1 - y])
        good = {bytes(r["segment"]) for r in grams.filter(wanted).select("segment").collect()}
        runs = []
        if good:
            runs = _frequency(docs.filter(F.col("y") == y), lambda words, good=good: _runs(words, good))
            runs = runs.filter(own >= max(2, 0.66 * least[y] * n[y])).select("segment", own.alias("held")).collect()
        chosen: list[bytes] = []
        for run, _ in sorted(((bytes(r["segment"]), r["held"]) for r in runs), key=lambda x: (-x[1], x[0])):
            if sum(map(len, chosen)) >= size:
                break
            if not any(run in c for c in chosen):
                chosen.append(run)
        out.append(b"".join(reversed(chosen)) + tail)
    return out[0], out[1]


def _compressor(raw: bytes):
    content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(**LEVEL), dict_data=content)


@dataclass
class ToxicityModel:
    """Dictionary content and calibrated weights; a few tens of kilobytes."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, texts) -> np.ndarray:
        """A row for each text: the bytes that the toxic dictionary takes less than the ordinary one in its windows."""
        toxic, ordinary = _compressor(self.toxic), _compressor(self.ordinary)
        out = []
        for text in texts:
            words, row = normal(text), []
            for k in WINDOWS:
                saved = np.zeros(max(1, -(-len(words) // k)))
                for n, i in enumerate(range(0, len(words), k)):
                    w = (" " + " ".join(words[i : i + k]) + " ").encode()
                    saved[n] = len(ordinary.compress(w)) - len(toxic.compress(w))
                top = np.sort(saved)[::-1]
                row += [top[0], top[:3].mean(), saved.mean(), saved.clip(0).mean(), *((saved >= c).mean() for c in CUTS)]
            out.append(row)
        return np.array(out)

    def score(self, texts) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        z = np.c_[(self.features(texts) - self.mean) / self.scale, np.ones(len(texts))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(docs: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """The features of ``y, place, text`` and the classes, by class and place."""

    def run(batches):
        for batch in batches:
            for y, place, text in zip(*batch.columns, strict=True):
                row = model.features([text.as_py()])[0]
                yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (y.as_py(), place.as_py(), row.tolist())], names)

    names = ["y", "place", "row"]
    schema = "y long, place long, row array<double>"
    rows = docs.select("y", "place", "text").mapInArrow(tidy(run), schema).collect()
    rows.sort(key=lambda r: (-r["y"], r["place"]))
    return np.array([r["row"] for r in rows]), np.array([float(r["y"]) for r in rows])


def fit(docs: DataFrame, sizes: tuple[int, int], toxic_rate: float, threshold: float = THRESHOLD) -> ToxicityModel:
    """Dictionaries from one half of ``y, place, text``, weights and threshold from the other half.

    ``sizes`` are the numbers of ordinary and of toxic texts, whose places count from 0 in each class.
    """
    half = [-(-n // 2) for n in sizes]
    model = ToxicityModel(*train_dictionaries(docs.filter("place % 2 = 0"), half[1], half[0]))
    if sizes[0] < 2 or sizes[1] < 2:
        return model
    x, y = _features(docs.filter("place % 2 = 1"), model)
    weight = np.where(y == 1, toxic_rate / y.sum(), (1 - toxic_rate) / (1 - y).sum()) * len(y)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), 1e-3 * len(y) * np.eye(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
    # the score at which precision and recall balance best becomes the threshold
    logit = z @ w
    order = np.argsort(-logit)
    hit, all_ = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    best = int(f1.argmax())
    cut = logit[order[best]] if best + 1 == len(order) else (logit[order[best]] + logit[order[best + 1]]) / 2
    w[-1] += np.log(threshold / (1 - threshold)) - cut
    model.weights = w
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_docs: int = MAX_DOCS,
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows given.

    At most ``max_docs`` documents of each class are used, those of the least hash of their id, each
    with its whole text, which stays on the executors. A document that is labelled more than once
    counts as toxic if any label says so. Null labels and ids are left out. Without labelled
    documents of both classes every score is 0.
    """
    seen = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y"))
    seen = seen.dropna().groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return ToxicityModel(b"", b"")
    chosen = [
        r
        for y in (0, 1)
        for r in seen.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs).collect()
    ]
    picked = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in chosen], "id long, y int")
    text = F.coalesce(docs[text_col], F.lit("")).cast("string").alias("text")
    texts = docs.select(docs[id_col].cast("long").alias("id"), text).join(F.broadcast(picked), "id")
    texts = materialize(texts.withColumn("digest", F.sha2("text", 256)))
    rows = [tuple(r) for r in texts.select("id", "y", "digest").distinct().collect()]
    rows.sort(key=lambda r: (r[0] * 2654435761 % 2**32, r[0], r[2]))
    first: dict = {}
    for id_, y, digest in rows:  # of equal texts of a class, the first
        first.setdefault((y, digest), id_)
    count, places = [0, 0], []
    for (y, digest), id_ in first.items():
        places.append((id_, digest, count[y]))
        count[y] += 1
    if not places:
        return ToxicityModel(b"", b"")
    places = docs.sparkSession.createDataFrame(places, "id long, digest string, place long")
    sample = texts.join(F.broadcast(places), ["id", "digest"]).dropDuplicates(["id", "digest"])
    return fit(materialize(sample.select("y", "place", "text")), tuple(count), sizes[1] / (sizes[0] + sizes[1]))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: one row per input row, over its whole text, in windows.

    Scores lie between 0 and 1. Null and empty texts get the score of a text without windows; null
    ids and repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch):
                scores = pa.array(model.score(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), scores], ["doc_id", "score"])

    return _two(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay.

    Rows never move, so nothing is shuffled. Null text counts as empty.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = model.score([t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
