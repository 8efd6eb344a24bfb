"""Shared by the iterative operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set for checkpoints; a temporary one only on one machine and where none is set."""
    sc = spark.sparkContext
    held, named = sc._jsc.sc().getCheckpointDir(), sc.getConf().get("spark.checkpoint.dir")
    if held.isEmpty():
        if not (named or sc.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """df in memory, or on disk where memory is short, while it is used; then it is let go."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()
