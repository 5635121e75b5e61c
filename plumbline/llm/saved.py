"""Tables written to the shared checkpoint folder, to cut lineage and to compute a shared input once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
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


#: Rows in a task, about, where a table is small beside what it was made of; tasks at least.
IN_TASK, TASKS = 250_000, 12


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it survives lost executors and has no lineage.

    With ``rows``, about how many rows it has at most, its last tasks and files are as many as these call for, and no more.
    """
    if rows is not None:
        df = df.coalesce(max(TASKS, -(-rows // IN_TASK)))
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
