"""The registered query of every training-data operator: production parameters on the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codequery.llm._support import table

#: The public vocabulary that texts are encoded with; a parameter of the query.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.quality import report

    return report(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    from codequery.llm.sentencepiece import encoded

    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model).selectExpr("doc_id", "cast(size(ids) as bigint) AS n_ids", "n_bytes", "round_trip", "ids")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.mixing import report

    return report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.warc import report

    return report(table(spark, sf_dir, "pages"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.pii import found

    return found(table(spark, sf_dir, "documents"))


def op8_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.vectors import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.simhash import report

    return report(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequery.llm.pu import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
