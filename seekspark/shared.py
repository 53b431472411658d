"""Helpers all operators share: table access and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables; columns and filters that follow reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which survives the loss of an executor.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset, as in tests on
    one machine, a temporary folder is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()
