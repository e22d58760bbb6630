"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    That is spark.checkpoint.dir; only where it is unset and all run on one machine, as in tests, a
    temporary one is chosen.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="palimpsest-"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/palimpsest/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` with its rows written to the checkpoint folder, where a lost executor does not reach them.

    The folder is that of ``shared_folder``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
