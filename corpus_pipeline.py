"""A pipeline over ``documents``: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage reads what the one before it has written. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from splatspark.llm.common import table
from splatspark.llm.decontamination import decontaminated
from splatspark.llm.line_dedup import deduplicated
from splatspark.llm.packing import packed
from splatspark.llm.quality_rules import quality_filter
from splatspark.llm.simhash import one_of_each_group
from splatspark.operators.matching import own_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go, as they have no words; repeated rows are judged each. An empty table gives an empty one, here and in all stages."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources are the sites; a null source is one. No row goes; a null text stays null."""
    return deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each group stays, and rows with a null id. Empty texts are copies of each other."""
    return one_of_each_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go; null and empty texts are not contaminated."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences instead of documents; a null or empty text is its end id alone."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: Suffix arrays, min-hashes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage returns is written as Parquet in the shared folder that the cluster names."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or own_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
