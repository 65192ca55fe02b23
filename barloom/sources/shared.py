"""The shared folder of a cluster, and results several branches read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without one falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoints ``df`` reliably, so that branches read it instead of redoing it.

    Meant for results that are small or expensive and used several times, such as
    the outcome of a recursion.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
