"""Incremental indexing and logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequery.functions.text import tokens


def indexed_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """New files of (path, text) below ``source`` become token counts in ``target``; a file already indexed is replaced.

    A batch writes its own folder, named by its id, so that a batch that is run again replaces itself.
    """
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        last = batch.dropDuplicates(["path"])
        out = last.select("path", F.explode(tokens(F.col("text"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The index as the last batch of each path left it."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"], "left_semi").select("path", "term", "tf")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of a stream of (ts, event_type) in tumbling windows, late rows up to a limit."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
