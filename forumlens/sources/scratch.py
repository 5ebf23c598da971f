"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from forumlens.session import ensure_checkpoint_dir

TASK_ROWS = 1 << 18


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    This cuts the lineage and survives lost executors; ``checkpoint()`` would compute the
    plan twice. ``discard`` removes a table that nothing reads any more; the folder is the
    cluster's scratch space, and what is left in it is cleared by its owner.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for the sorts and joins of ``rows`` rows: about ``TASK_ROWS`` each, so that a task's
    memory does not grow with the table. Adaptive execution keeps a number that is given, but merges
    the session's partitions up to 64 MB of compressed rows, which sorted take many times that."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def discard(table: DataFrame) -> None:
    """Delete the files of a ``scratch`` table, such as a superseded round of a loop.

    Only for tables that no frame still to be run reads.
    """
    spark: SparkSession = table.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        home = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.toUri().getPath().startswith(home.toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
