"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="keytide-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Used on narrow intermediate tables that several later steps read, so that those steps neither
    repeat the work nor lose it with an executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
