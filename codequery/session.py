"""Session helpers: the folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode. A cluster must name one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codequery-")
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Rows of a partition where a table is dealt into as many as its size asks for.
PART_ROWS = 250_000


def parts(spark: SparkSession, rows: int) -> int:
    """In how many partitions so many rows go, so that a task's memory doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def deleted(spark: SparkSession, folder: str) -> None:
    """Removes a folder that a run has made in the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
