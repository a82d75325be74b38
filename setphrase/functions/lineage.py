"""Cutting the lineage of iterative operators, by tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    A local session without one (tests, a single machine) gets a temporary folder, which goes when
    the program ends. On a cluster no folder of one machine will do, so that is an error.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="setphrase-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast where it is joined if it has at most so many rows, which are counted; meant for tables that are kept anyway."""
    return F.broadcast(df) if df.count() <= most else df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
