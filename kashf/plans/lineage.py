"""Cuts of the lineage, where several branches of a plan need the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names, or else one in the warehouse, which driver and executors share as well.

    A master with executors of its own must name a folder: a local warehouse would be another one on each machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    base = spark.conf.get("spark.sql.warehouse.dir")
    if not sc.master.startswith("local[") and sc.master != "local" and base.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
