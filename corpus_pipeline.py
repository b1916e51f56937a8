"""A corpus from documents to token ids: quality, near copies, benchmark passages, source weights, token table.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, jaccard, mixing, quality
from millrace.llm.queries import token_table
from millrace.operators.shared import settle
from millrace.sources.tables import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the quality classifier scores under 0.5."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more over five-word shingles, one stays."""
    return jaccard.drop_near_copies(docs, width=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of eight words of any benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; a document that is taken twice is there twice."""
    return mixing.mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_table(docs)


STAGES = [("quality", good), ("near_copies", distinct), ("decontamination", clean), ("mixing", mixed), ("tokens", encoded)]

# A trained classifier decides in the first stage: no SQL. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
