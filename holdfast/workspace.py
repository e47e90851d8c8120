"""Tables written between stages, so that a lost executor costs no more than one stage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A session that names none, with its driver and executors in one process, gets a scratch folder,
    as in tests. Elsewhere a missing setting is an error, because a folder of one machine would not
    survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="holdfast-"))
    return context.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_folder(spark)}/holdfast/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all tables of this application; frames that read them cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, below a folder named after the application.

    The tables stay until :func:`release` or whoever owns the shared folder removes them.
    """
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and go on from the written table.

    Used where several passes read the same result: the columnar table lets each pass scan only
    the columns it needs, and nothing upstream is computed again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
