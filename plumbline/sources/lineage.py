"""Tables written to the folder the cluster names, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; without one an error on a cluster, and a folder of our own in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")  # one machine, one process
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark finds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """df without lineage: written as Parquet and read again, a fraction of the size of a checkpoint's serialised rows."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
