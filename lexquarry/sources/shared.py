"""The folder that driver and executors share, and tables of raw texts spread over the cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder set as spark.checkpoint.dir. Where none is set, a folder of our own, in local mode only: there one machine has it all."""
    sc = spark.sparkContext
    set_ = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexquarry-"))
        set_ = sc.getCheckpointDir()
    return set_.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, however often it is used."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are: one row group is one task, however long its texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
