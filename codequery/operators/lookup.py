"""Lookups, hints after empty results, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.functions import text as X


def by_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    return docs.join(ids, column, "left_semi")


def by_prefix(docs: DataFrame, column: str, prefix: str, most: int = 50) -> DataFrame:
    """Rows whose id begins with ``prefix``, the first ``most``."""
    return docs.where(F.col(column).startswith(prefix)).orderBy(column).limit(most)


def did_you_mean(docs: DataFrame, words: DataFrame, edits: int = 2, top: int = 5) -> DataFrame:
    """(query_id, rank, name, distance): indexed names within ``edits`` of each probe word of three characters or more.

    ``words`` is the query batch (query_id, text). A probe meets the names of the lengths that can be near.
    """
    probe = F.lower(F.regexp_extract(F.trim("text"), r"^([^\s#.(]*)", 1))
    q = words.select("query_id", probe.alias("probe")).where(F.length("probe") >= 3)
    names = docs.select(F.explode(F.array("name", "class_name")).alias("name")).where("name <> ''").distinct().withColumn("low", F.lower("name"))
    q = q.withColumn("_length", F.explode(F.sequence(F.length("probe") - edits, F.length("probe") + edits)))
    pairs = names.join(q, F.length("low") == F.col("_length"))
    near = pairs.withColumn("distance", F.levenshtein("low", "probe")).where(F.col("distance") <= edits)
    best = Window.partitionBy("query_id").orderBy("distance", "name")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "name", "distance")


def token_hits(docs: DataFrame, words: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(query_id, token, found): whether each word of queries with several occurs anywhere."""
    q = words.select("query_id", X.tokens(F.col("text")).alias("t")).where(F.size("t") > 1).select("query_id", F.explode("t").alias("token")).where(F.length("token") >= 3).distinct()
    every = docs.select(F.explode(F.array_distinct(F.flatten(F.array(*(X.tokens(F.col(f)) for f in fields))))).alias("token"))
    known = every.join(q.select("token").distinct(), "token", "left_semi").distinct().withColumn("found", F.lit(True))
    return q.join(known, "token", "left").select("query_id", "token", F.coalesce("found", F.lit(False)).alias("found"))


def filter_note(hits: DataFrame, keep: Column) -> DataFrame:
    """(query_id, without, with_filter): hits with and without a filter."""
    return hits.groupBy("query_id").agg(F.count("*").alias("without"), F.sum(keep.cast("int")).cast("long").alias("with_filter"))


def best_line(docs: DataFrame, terms: DataFrame, body: str = "body") -> DataFrame:
    """(query_id, doc_id, line): the first line with the heaviest query word; ``terms`` is (query_id, term, w), few rows."""
    lines = docs.select("query_id", "doc_id", F.posexplode(F.split(body, "\n")).alias("line", "text"))
    words = lines.select("query_id", "doc_id", "line", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    hit = words.join(terms, ["query_id", "term"]).groupBy("query_id", "doc_id", "line").agg(F.max("w").alias("w"))
    return hit.groupBy("query_id", "doc_id").agg(F.max_by("line", F.struct("w", -F.col("line"))).alias("line"))


def snippet(body: Column, keyword_line: Column, vector_line: Column, width: Column) -> Column:
    """A window of lines around one hint, the middle of two near ones, two windows for far ones, or the beginning."""
    lines = F.split(body, "\n")
    n, w = F.size(lines), F.greatest(F.lit(5), F.least(F.lit(50), width))
    clamp = lambda x: F.greatest(F.lit(0), F.least(n - 1, x))
    k, v = clamp(keyword_line), clamp(vector_line)

    def part(start: Column, size: Column) -> Column:
        return F.array_join(F.slice(lines, F.greatest(F.lit(0), start).cast("int") + 1, F.greatest(F.lit(0), size).cast("int")), "\n")

    half = lambda x: F.floor(x / 2).cast("int")
    centred = lambda at: part(F.greatest(F.lit(0), F.least(at - half(w), n - w)), w)
    third = F.greatest(F.lit(3), F.floor(w / 3).cast("int"))
    v_from = F.greatest(F.lit(0), v - third)
    v_to = F.least(n, v_from + 2 * third)
    k_from = F.greatest(v_to, k - half(third))
    two = F.when(k > v, F.concat(part(v_from, v_to - v_from), F.lit("\n// ...\n"), part(k_from, 2 * third))).otherwise(F.concat(part(F.greatest(F.lit(0), k - half(third)), F.least(2 * third, v_from - F.greatest(F.lit(0), k - half(third)))), F.lit("\n// ...\n"), part(v_from, v_to - v_from)))
    return (
        F.when(keyword_line.isNull() & vector_line.isNull(), part(F.lit(0), w)).when(vector_line.isNull(), centred(k)).when(keyword_line.isNull(), centred(v))
        .when(F.abs(k - v) <= half(w), centred(half(k + v))).otherwise(two)
    )


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` of a text, from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(F.lit(1), start), F.greatest(F.lit(0), end - F.greatest(F.lit(1), start) + 1)), "\n")
