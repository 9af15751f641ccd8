"""Corpus pipeline over the documents table: five stages, each one of the training-data operators.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.

1. language: documents without a language (``und``), or in none of the learned ones by their code length, go.
2. toxicity: documents with a score of 0.5 or more go.
3. near_duplicates: of each SimHash component the row with the smallest id stays (null last), whatever
   other rows have that id; of rows equal in id and fingerprint one stays.
4. decontamination: documents that contain a benchmark item go.
5. segmentation: the N-best segmentations of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, langid, segmentation, simhash, toxicity
from quillmill.llm.common import settle, table

#: The stages of language models and hash forests are not expressible in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(scorer, docs, F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(decontaminate.clean_column(table(spark, sf_dir, "benchmark")))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentation.segment(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("segmentation", segmented),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
