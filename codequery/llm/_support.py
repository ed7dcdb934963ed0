"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local
    mode. A cluster must name one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or context.getCheckpointDir()
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


def packed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, which has about so many rows, in no more partitions than these fill: shuffles of a small table then write
    few files, whatever the number of partitions that it came in."""
    return df.coalesce(max(1, -(-rows // each)))


def deleted(spark: SparkSession, folder: str) -> None:
    """Removes a folder that a run has made in the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
