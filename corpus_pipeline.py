"""A training corpus from documents, in stages.

Each stage takes all its predecessor kept and is written as Parquet before the next one reads it.
Stages but the last return the columns of documents; the last returns packed pieces. When a stage
begins, what the stage before it wrote for its own use is removed, for by then its result is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, recorded, remove, table
from palimpsest.llm.exact_dedup import drop_exact_copies
from palimpsest.llm.minhash import drop_near_duplicates
from palimpsest.llm.packing import pack
from palimpsest.llm.substrings import drop_repeats
from palimpsest.llm.toxicity import drop_toxic, train

TOKENIZER = "word_bpe_49k.json"
#: Rows of one Arrow batch: whole documents, so that a worker holds a few megabytes of them at a time.
BATCH_ROWS = 1000
#: Words of a generation of the packing's cache: executors still hold what the stages before took.
WORDS_KEPT = 100_000
#: By input, the folders that the stage before has written for its own use.
_scratch: dict[tuple[str, str], list[str]] = {}


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _scratch.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        remove(spark, own)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        with recorded(own):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from all labelled documents."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of least id stays."""
    return drop_exact_copies(docs, keep="min")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 or more, the document of least id stays."""
    return drop_near_duplicates(docs, percent=80)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur before are cut out; n_chars follows the text."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids, as pieces of documents."""
    return pack(docs, public_tokenizers.path(TOKENIZER), words_kept=WORDS_KEPT)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: No SQL says what the classifier, the tokenizer and the packing do; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = materialize(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
