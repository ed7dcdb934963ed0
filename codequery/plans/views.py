"""How the fixed tables are read as documents, vectors and graphs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codequery.functions.text import TOKEN
from codequery.session import parts

PATHS = ("src/main/java/a/B.java", "src/test/java/a/BTest.java", "x/benchmark/Run.java", "x/jmh/Run.java", "docs/readme.md", "x/.github/ci.java", "lib/test/T.java", "notes.txt", "src/main/py/m.py")
KINDS = ("class", "method", "chunk", "doc")
CLASS_TYPES = ("interface", "abstract", "class", "enum", "record", "annotation")
ACCESS = ("public", "protected", "private", "")
FIELDS = ("name", "class_name", "javadoc", "signature", "annotations", "caller_context", "body")
QUERIES = [(1, "anea eriner thanea"), (2, "the and attion to thanedble"), (3, "Apache License Version"), (4, "erThe_reanea nicht")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn(names: tuple[str, ...], by) -> F.Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (by % len(names) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as code documents: names and comment from the first line, signature from the second."""
    d = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    line = lambda k: F.split_part(body, F.lit("\n"), F.lit(k))
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.col("source").alias("project"), "lang", F.regexp_extract(line(1), r"^\S+( \S+)?", 0).alias("name"), F.concat(F.lit("C"), (i % 50).cast("string")).alias("class_name"), line(1).alias("javadoc"),
        line(2).alias("signature"), F.col("lang").alias("annotations"), F.col("source").alias("caller_context"), body.alias("body"), _turn(KINDS, i).alias("doc_type"),
        F.when(i % 7 < 6, _turn(CLASS_TYPES, i % 7)).alias("class_type"), F.when(i % 5 < 4, _turn(ACCESS, i % 5)).alias("access"), _turn(PATHS, i).alias("file_path"), (i % 13).alias("in_degree"),
    )


def _sql_turn(names: tuple[str, ...], by: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{by} % {len(names)} + 1]"


DOCS = f"""docs AS (
  SELECT doc_id, source AS project, lang, regexp_extract(split_part(coalesce(text, ''), chr(10), 1), '^\\S+( \\S+)?', 0) AS name, 'C' || (doc_id % 50) AS class_name, split_part(coalesce(text, ''), chr(10), 1) AS javadoc,
    split_part(coalesce(text, ''), chr(10), 2) AS signature, lang AS annotations, source AS caller_context, coalesce(text, '') AS body, {_sql_turn(KINDS, 'doc_id')} AS doc_type,
    CASE WHEN doc_id % 7 < 6 THEN {_sql_turn(CLASS_TYPES, '(doc_id % 7)')} END AS class_type, CASE WHEN doc_id % 5 < 4 THEN {_sql_turn(ACCESS, '(doc_id % 5)')} END AS access, {_sql_turn(PATHS, 'doc_id')} AS file_path,
    doc_id % 13 AS in_degree FROM documents)"""
SQL_TOKEN = TOKEN.replace("'", "''")


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{SQL_TOKEN}')"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (0, 1, 7)) -> DataFrame:
    """The vectors of a few stated ids as queries."""
    return vectors(spark, sf_dir).where(F.col("doc_id").isin(*ids)).select(F.col("doc_id").cast("int").alias("query_id"), "vec")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = parts(spark, lines.count())
    rows = lines.repartition(n, "l_orderkey").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst IS NOT NULL AND src <> dst").repartition(n, "src", "dst").distinct()


EDGES = """edges AS (
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
