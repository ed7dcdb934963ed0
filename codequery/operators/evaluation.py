"""Ranking metrics, benchmarks, parameter searches and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.operators.fusion import tagged


def graded(run: DataFrame, qrels: DataFrame, class_of: DataFrame | None = None) -> DataFrame:
    """``run`` (query_id, rank, doc_id) with ``grade``: that of the document, else that of its class, else 0."""
    direct = qrels.where("doc_id IS NOT NULL").select("query_id", "doc_id", F.col("grade").alias("_d"))
    out = run.join(direct, ["query_id", "doc_id"], "left")
    if class_of is None:
        return out.withColumn("grade", F.coalesce("_d", F.lit(0))).drop("_d")
    by_class = qrels.where("doc_id IS NULL").select("query_id", "class_name", F.col("grade").alias("_c"))
    out = out.join(class_of.select("doc_id", "class_name"), "doc_id", "left").join(by_class, ["query_id", "class_name"], "left")
    return out.withColumn("grade", F.coalesce("_d", "_c", F.lit(0))).drop("_d", "_c")


def metrics(rows: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, mrr, p, r, ndcg, ap) at ``k`` of graded rows."""
    rows = rows.where(F.col("rank") <= k)
    hit = (F.col("grade") > 0).cast("int")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(upto))
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    got = rows.groupBy("query_id").agg(
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("hit").alias("n"), F.sum(gain(F.col("grade")) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("precisions")
    )
    good = qrels.where("grade > 0").withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"))))
    ideal = good.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade")) / F.log2(F.col("i") + 1))).alias("idcg"))
    out = got.join(ideal, "query_id", "left")
    none = F.coalesce("relevant", F.lit(0)) == 0
    return out.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("n") / k, 6).alias("p"), F.round(F.when(none, 1.0).otherwise(F.col("n") / F.col("relevant")), 6).alias("r"),
        F.round(F.when(none, 0.0).otherwise(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(F.when(none, 0.0).otherwise(F.coalesce("precisions", F.lit(0.0)) / F.col("relevant")), 6).alias("ap"),
    )


def hit_ranks(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, hit): the first rank at which an id is a prefix of the true one, or the other way about; null without a hit."""
    either = F.startswith("result_id", "truth_id") | F.startswith("truth_id", "result_id")
    rows = run.join(truth.select("query_id", "truth_id"), "query_id").where(either).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return truth.select("query_id").join(rows, "query_id", "left")


def benchmark(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Precision at 1, 3, 5 and 10, MRR and NDCG at 10: overall, by category and by project."""
    rows = hits.join(queries.select("query_id", "category", "project"), "query_id")
    at = lambda k: F.round(F.avg((F.coalesce(F.col("hit"), F.lit(99)) <= k).cast("double")), 6).alias(f"p{k}")
    inside = F.col("hit") <= 10
    grouped = rows.groupingSets([[], ["category"], ["project"]], "category", "project")
    return grouped.agg(
        F.count("*").alias("n"), at(1), at(3), at(5), at(10), F.round(F.avg(F.when(inside, 1 / F.col("hit")).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(F.when(inside, 1 / F.log2(F.col("hit") + 1)).otherwise(0.0)), 6).alias("ndcg")
    )


def regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Queries whose hit rank got worse, no hit counting as 99."""
    both = old.withColumnRenamed("hit", "old").join(new.withColumnRenamed("hit", "new"), "query_id")
    filled = both.select("query_id", F.coalesce("old", F.lit(99)).alias("old"), F.coalesce("new", F.lit(99)).alias("new"))
    return filled.where("new > old")


def last_ratings(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by ``ts``, ties by the largest rating."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("rating"))
    return ratings.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def weight_grid(lists: list[DataFrame], truth: DataFrame, steps: int = 10, k: int = 10) -> DataFrame:
    """(w, mrr): MRR of the weighted Borda merge of two lists for each first weight in steps of ``1 / steps``."""
    rows = tagged(lists).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "list")))
    each = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps))))  # a fixed few rows each
    w = F.col("step") / steps
    points = F.when(F.col("list") == 0, w).otherwise(1 - w) * (F.col("n") - F.col("rank") + 1)
    sums = each.groupBy("step", "query_id", "doc_id").agg(F.sum(points).alias("s"), F.countDistinct("list").alias("m"))
    sums = sums.withColumn("score", F.round(F.col("s") * F.when(F.col("m") == 2, 1.5).otherwise(1.0), 6))
    order = sums.withColumn("rank", F.row_number().over(Window.partitionBy("step", "query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    first = order.join(truth, ["query_id", "doc_id"], "left_semi").groupBy("step", "query_id").agg(F.min("rank").alias("hit"))
    every = order.select("step", "query_id").distinct().join(first, ["step", "query_id"], "left")
    return every.groupBy("step").agg(F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles of a value by group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p}") for p in percents))


def nth_best(rows: DataFrame, by: Column, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
