"""Merging ranked lists and reranking them. Lists are (query_id, rank, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.operators.retrieval import ranked

AGREEMENT, RRF_K, DECAY = 1.5, 60, 0.5
#: Weights of words and vectors by intent.
BORDA_WEIGHTS = {"KEYWORD_TECHNICAL": (0.9, 0.1), "CONFIG": (0.8, 0.2), "BEHAVIORAL": (0.7, 0.3), "INTERFACE": (0.6, 0.4)}
#: Bonus of words in unified retrieval by intent; none: UNIFIED_NONE.
UNIFIED_BONUS = {
    "KEYWORD_TECHNICAL": 0.7, "CONFIG": 0.8, "BEHAVIORAL": 0.15, "INTERFACE": 0.05, "ABSTRACT": 0.05, "ENUM": 0.05, "RECORD": 0.05, "ANNOTATION": 0.05,
    "IMPLEMENTATION": 0.2, "JAVADOC": 0.5, "LIFECYCLE": 0.5, "KEYWORD": 0.3, "HYBRID": 0.1,
}
UNIFIED_NONE = 0.3
#: neighbours' share of their parent's score, and boosts of projects and hints.
NEIGHBOUR, AFFINITY, EXPLICIT, IMPLICIT = 0.5, 1.5, 1.8, 1.3


def tagged(lists: list[DataFrame]) -> DataFrame:
    """All lists' rows with ``list``, their number."""
    return reduce(DataFrame.unionByName, [x.select("query_id", "rank", "doc_id", "score").withColumn("list", F.lit(i)) for i, x in enumerate(lists)])


def borda(lists: list[DataFrame], weights: list[float] | None = None, limit: int | None = None) -> DataFrame:
    """Points ``weight * (n - rank + 1)`` with n the list's length; of exactly two lists, half as much again for what both hold."""
    two = len(lists) == 2
    weights = weights or [0.5] * 2 if two else [1.0] * len(lists)
    rows = tagged(lists).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "list")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("list") + 1)
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum(weight * (F.col("n") - F.col("rank") + 1)).alias("s"), F.countDistinct("list").alias("k"))
    return ranked(sums.select("query_id", "doc_id", (F.col("s") * F.when((F.col("k") == 2) & F.lit(two), AGREEMENT).otherwise(1.0)).alias("score")), limit)


#: Weights of words and vectors in the older hybrid, for names and for other queries.
NAME_WEIGHTS, OTHER_WEIGHTS = (0.8, 0.2), (0.5, 0.5)


def camel_hybrid(words: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """The older hybrid: a Borda merge whose weights favour words where the query (query_id, text) names a class or an
    acronym; without vector hits a query keeps its words' ranking."""
    named = F.exists(F.split("text", r"\s+"), lambda w: F.rlike(w, F.lit(r"^(?:[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*|[A-Z]{3,})$")))
    kind = queries.select("query_id", named.alias("_named"))
    rows = tagged([words, vectors]).withColumn("n", F.count("*").over(Window.partitionBy("query_id", "list"))).join(kind, "query_id")
    pick = lambda i: F.when(F.col("_named"), NAME_WEIGHTS[i]).otherwise(OTHER_WEIGHTS[i])
    weight = F.when(F.col("list") == 0, pick(0)).otherwise(pick(1))
    sums = rows.groupBy("query_id", "doc_id").agg(
        F.sum(weight * (F.col("n") - F.col("rank") + 1)).alias("s"), F.countDistinct("list").alias("k"),
        F.max(F.when(F.col("list") == 0, F.col("score"))).alias("w"),
    )
    both = vectors.select("query_id").distinct().withColumn("_v", F.lit(True))
    score = F.when(F.col("_v"), F.col("s") * F.when(F.col("k") == 2, AGREEMENT).otherwise(1.0)).otherwise(F.col("w"))
    return ranked(sums.join(both, "query_id", "left").select("query_id", "doc_id", score.alias("score")), limit)


def rrf(lists: list[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal ranks ``1 / (k + rank)``; of exactly two lists, half as much again for what both hold."""
    sums = tagged(lists).groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("s"), F.countDistinct("list").alias("n"))
    return ranked(sums.select("query_id", "doc_id", (F.col("s") * F.when((F.col("n") == 2) & F.lit(len(lists) == 2), AGREEMENT).otherwise(1.0)).alias("score")), limit)


def pooled(lists: list[DataFrame]) -> DataFrame:
    """Each document once, as the first list has it."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("list", "rank")
    return tagged(lists).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def cross_encoded(lists: list[DataFrame], texts: DataFrame, queries: DataFrame, score: Column | None, limit: int) -> DataFrame:
    """The pooled lists in the order of a pair score over ``query`` and ``passage``; without one, in the pool's order."""
    pool = pooled(lists)
    if score is None:
        order = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "rank", "doc_id")))
        return order.where(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")
    pairs = pool.select("query_id", "doc_id").join(texts.select("doc_id", "passage"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return ranked(pairs.select("query_id", "doc_id", score.alias("score")), limit)


def diversified(hits: DataFrame, key: Column, limit: int | None = None, decay: float = DECAY) -> DataFrame:
    """``score * decay^n`` for the n-th earlier hit of the same key: class, or kind of document."""
    if not 0 <= decay <= 1:
        raise ValueError("decay must lie between 0 and 1")
    nth = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "doc_id")) - 1
    return ranked(hits.withColumn("_key", key).select("query_id", "doc_id", (F.col("score") * F.pow(F.lit(decay), nth)).alias("score")), limit)


def boosted(hits: DataFrame, when: Column, factor: float) -> DataFrame:
    """Hits with the score of some multiplied."""
    return hits.withColumn("score", F.when(when, F.col("score") * factor).otherwise(F.col("score")))


def with_neighbours(hits: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """The hits and the callees of the best ones at half the score, each once, under its first parent."""
    near = hits.where(F.col("rank") <= top).join(edges.select("src", "dst").distinct(), F.col("doc_id") == F.col("src"))
    near = near.select("query_id", "rank", F.col("dst").alias("doc_id"), (F.col("score") * NEIGHBOUR).alias("score"))
    near = near.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    first = Window.partitionBy("query_id", "doc_id").orderBy("rank")
    near = near.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("query_id", "doc_id", "score", F.lit("related").alias("kind"))
    return hits.select("query_id", "doc_id", "score", F.lit("primary").alias("kind")).unionByName(near)
