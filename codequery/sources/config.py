"""Readers of what users keep beside an index: registries, rated queries, pipelines, intents and synonym rules.

These files are small and are read on the driver or by one task; the tables that they give are parameters of a search.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING = "query string, project string, pipeline string, result_id string, rank int, rating string, ts string"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(project, path, group_id, artifact_id): a JSON object of projects by name."""
    fields = "map<string, struct<path:string,groupId:string,artifactId:string>>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", fields)).alias("project", "p"))
    return rows.select("project", "p.path", F.col("p.groupId").alias("group_id"), F.col("p.artifactId").alias("artifact_id"))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """User ratings, a JSON object a line; lines that are none are left out."""
    return spark.read.schema(RATING).option("mode", "DROPMALFORMED").json(path).where("query IS NOT NULL")


def intents(spark: SparkSession, path: str) -> DataFrame:
    """(phrase, intent, doc_type) of a CSV file with a header; phrases in lower case, once each."""
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.select(F.lower(F.trim("phrase")).alias("phrase"), F.trim("intent").alias("intent"), F.nullif(F.trim("doctype"), F.lit("")).alias("doc_type"))
    return rows.where("phrase IS NOT NULL AND phrase <> ''").groupBy("phrase").agg(F.min("intent").alias("intent"), F.min("doc_type").alias("doc_type"))


def _phrases(text) -> F.Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def synonyms(lines: DataFrame) -> DataFrame:
    """(lhs, rhs) of rule lines (value): ``a, b => c`` leads from left to right, ``a, b, c`` from each to the others;
    what follows a number sign is a remark."""
    rows = lines.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("v")).where("v <> ''")
    parts = F.split("v", "=>", 2)
    side = lambda k: _phrases(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    directed = rows.where(F.contains("v", F.lit("=>"))).select(side(0).alias("l"), side(1).alias("r"))
    mutual = rows.where(~F.contains("v", F.lit("=>")) & F.contains("v", F.lit(","))).select(_phrases("v").alias("l"))
    both = directed.unionByName(mutual.select("l", F.col("l").alias("r")))
    return both.select(F.explode("l").alias("lhs"), "r").select("lhs", F.explode("r").alias("rhs")).where("lhs <> rhs").distinct()


def _value(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [x.strip() for x in text[1:-1].split(",") if x.strip()]
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"\d+", text) else text.strip("\"'")


def pipelines(text: str) -> list[dict]:
    """The pipelines of a YAML file of the form that they are written in: a list of mappings whose values are words,
    numbers, lists in brackets, or one mapping of words further in."""
    out: list[dict] = []
    inner: str | None = None
    for raw in text.split("\n"):
        line = re.sub(r"(?:^|\s)#.*$", "", raw).rstrip()
        m = re.fullmatch(r"(\s*)(- )?([\w.-]+):\s*(.*)", line)
        if not m or m[3] == "pipelines" and not m[1]:
            continue
        if m[2]:
            out.append({})
            inner = None
        depth = len(m[1]) + 2 * bool(m[2])
        if not out:
            continue
        if depth > 4 and inner:
            out[-1][inner][m[3]] = _value(m[4])
        elif m[4]:
            out[-1][m[3]], inner = _value(m[4]), None
        else:
            out[-1][m[3]], inner = {}, m[3]
    return [p for p in out if "name" in p]


def pipeline_table(spark: SparkSession, text: str) -> DataFrame:
    """(name, visible, retrievers, merger, rerankers, oversample, requires, dispatches) of a pipelines file."""
    rows = [
        (p["name"], p.get("visible", True), p.get("retrievers", []), p.get("merger"), p.get("rerankers", []), p.get("oversample", 1), p.get("requires", []), bool(p.get("dispatch")))
        for p in pipelines(text)
    ]
    schema = "name string, visible boolean, retrievers array<string>, merger string, rerankers array<string>, oversample int, requires array<string>, dispatches boolean"
    return spark.createDataFrame(rows, schema)
