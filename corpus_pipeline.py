"""The corpus pipeline: quality rules, near-duplicate removal, PII masking, source mixing, tokens.

Every stage takes the documents that the one before wrote and returns a table that the next one reads. All but the last
keep the columns of ``documents``; the last adds the token ids. The stages count words, link fingerprints and train as
their operators do, so no SQL gives their rows; tests hold them against plain Python.

Edge cases: a document with a null or empty text fails the quality rules and is gone after them; a null language or
source is a group of its own for the rules and the mix; a null id stays, judged by its row in the near-duplicate stage;
rows that share an id are judged each for itself; repeated rows count as copies; texts of any length go through whole; an
empty table gives no rows; further columns pass through, but for those called ``ids``, ``n_bytes`` or ``round_trip``,
which give way to the last stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codequery.llm import mixing, pii, quality, sentencepiece, simhash
from codequery.llm._support import deleted, shared_dir, table
from codequery.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.filtered(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked."""
    return pii.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each copy taken."""
    return mixing.mixed(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with token ids, and whether decoding them gives the text back."""
    return sentencepiece.encoded(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("pii", pii_masking),
    ("source mixing", source_mixing),
    ("sentencepiece", sentencepiece_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again. A stage's folder goes once the
    next one is written; the last one, which the result reads, is the caller's to remove with it."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            deleted(spark, f"{folder}/{k - 1}")
    return docs
