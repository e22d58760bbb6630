"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where it is unset and all run on one machine, as in tests, a temporary folder is chosen.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(folder)
    return folder


#: Where ``recorded`` notes the folders that are written.
_recorders: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Note the folders that ``materialize`` writes meanwhile, so that they can be removed later."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders, in whatever file system they are, and empty the list."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    The files outlive a lost executor. They stay until the owner of the folder clears it, or until
    whoever had them ``recorded`` removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/palimpsest/{uuid.uuid4().hex}"
    if _recorders:
        _recorders[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """``run`` over Arrow batches; afterwards the worker gives free memory back to the system.

    Python workers are used again by later stages, and what one leaves behind adds to the next.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
